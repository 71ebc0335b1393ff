"""Operators for large-scale training and link data. Nothing else in the library imports this package."""
