"""Structured Streaming forms of ingestion and throughput reports."""
