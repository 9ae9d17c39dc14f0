"""Operators over evidence tables; every function takes and returns DataFrames."""
