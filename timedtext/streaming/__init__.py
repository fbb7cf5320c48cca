"""Segments that arrive live, as Structured Streaming queries."""
