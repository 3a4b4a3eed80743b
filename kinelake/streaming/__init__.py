"""Structured Streaming forms of the frame-sequential operators."""
