"""Scalar building blocks used by the operators."""
