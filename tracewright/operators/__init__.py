"""Operators of the trace engine."""
