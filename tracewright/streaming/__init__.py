"""Structured Streaming variants of the sequence operators."""
