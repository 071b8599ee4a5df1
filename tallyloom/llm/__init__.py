"""Operators for text collections; nothing outside this package imports it."""
