"""Structured Streaming: incremental ingest and running views."""
