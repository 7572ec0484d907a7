"""Measures of files that keep arriving."""
