"""Operators for training-text corpora."""
