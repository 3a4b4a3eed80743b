"""Operators over long-form motion tables; each takes DataFrames with column names and returns a DataFrame."""
