"""Incremental maintenance over Structured Streaming."""
