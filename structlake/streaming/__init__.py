"""Structured Streaming jobs over arriving records."""
