"""Structured Streaming forms of the longitudinal operators."""
