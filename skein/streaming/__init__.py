"""Structured Streaming twins of the change cursor and of ingest."""
