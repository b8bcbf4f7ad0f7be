"""Catalog, query trees, their text form and their compilation to DataFrames."""
