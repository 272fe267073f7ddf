"""Operators on DataFrames: reshaping, linkage, aggregation, models, checks."""
