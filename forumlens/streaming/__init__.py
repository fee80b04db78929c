"""Structured Streaming versions of search, ingest and scoring."""
