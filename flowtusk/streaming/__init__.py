"""Structured Streaming forms of the analysis."""
