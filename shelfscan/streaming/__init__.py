"""Structured Streaming forms of the request and page operators."""
