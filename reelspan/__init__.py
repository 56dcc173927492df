"""Spark-native analytics over episodes, instructions, manifests and training text."""
