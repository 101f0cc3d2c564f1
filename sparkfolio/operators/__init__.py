"""Operators over the stored tables; each takes and returns DataFrames."""
