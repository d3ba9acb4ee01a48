"""Operators on DataFrames of records, hits, nodes and edges."""
