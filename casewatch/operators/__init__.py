"""Operators: each takes and returns DataFrames and stays lazy unless its docstring says otherwise."""
