"""Incremental use with Structured Streaming (H1, H2)."""
