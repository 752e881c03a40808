"""Operators that prepare chat text for training. Nothing outside this package imports it."""
