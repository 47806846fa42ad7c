"""Structured Streaming jobs over the audit tables."""
