"""Functions of the trace engine."""
