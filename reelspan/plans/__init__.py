"""Queries that bind the operators to the given tables."""
