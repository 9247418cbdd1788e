"""Structured Streaming versions of bar building and rolling state."""
