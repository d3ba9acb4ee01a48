"""Append-only logs on Structured Streaming."""
