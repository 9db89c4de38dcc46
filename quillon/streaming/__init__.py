"""Streaming forms of the summaries."""
