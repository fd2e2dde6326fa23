"""Structured Streaming forms of batch operators (incremental A1, K4)."""
