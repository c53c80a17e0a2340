"""Operators: every function takes a DataFrame and column names, returns a DataFrame."""
