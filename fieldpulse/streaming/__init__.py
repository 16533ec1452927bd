"""Structured Streaming: incremental ingest and live counts."""
