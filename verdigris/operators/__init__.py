"""Operators over DataFrames of vectors, records and pixels."""
