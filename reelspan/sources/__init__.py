"""Readers and sinks of the tables."""
