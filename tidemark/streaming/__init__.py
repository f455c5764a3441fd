"""Structured Streaming jobs over disclosure-like events."""
