"""Operators over DataFrames: grids, rules, charts, documents, styles."""
