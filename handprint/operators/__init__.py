"""Relational operators of the stylometry engine (long-format DataFrames)."""
