"""Structured Streaming jobs (incremental ingest)."""
