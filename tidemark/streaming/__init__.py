"""Structured Streaming versions of the late-data operators."""
