"""Operators over play tables: each takes and returns DataFrames."""
