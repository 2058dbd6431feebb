"""Operators: each takes and returns DataFrames and states its plan in built-in functions."""
