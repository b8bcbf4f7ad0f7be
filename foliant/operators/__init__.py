"""Operators on postings, document sets, docbases and results."""
