"""Incremental (restart-safe) processing with Structured Streaming."""
