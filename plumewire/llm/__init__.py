"""Operators for large training-text corpora."""
