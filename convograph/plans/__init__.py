"""Whole queries over the stored tables, and their SQL."""
