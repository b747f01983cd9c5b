"""Operators for training-data corpora. Nothing outside this package imports it."""
