"""Execution-trace analytics as Spark DataFrame functions."""
