"""Operators on DataFrames: extraction, derivation, estimation, disclosure control and reshaping."""
