"""Scalar functions: typed keys, XML text, paths."""
