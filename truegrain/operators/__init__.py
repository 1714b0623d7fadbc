"""Operators over DataFrames with a row number."""
