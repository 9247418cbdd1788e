"""Operators over bars, chains and equity curves: each takes and returns DataFrames."""
