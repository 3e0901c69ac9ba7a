"""Sources of the trace engine."""
