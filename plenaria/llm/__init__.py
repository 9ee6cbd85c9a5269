"""Operators that prepare parliamentary text for training data. Nothing outside this package imports it."""
