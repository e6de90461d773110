"""Inventory operators: each takes and returns DataFrames and runs no job by itself
unless its docstring says so."""
