"""Operators of a training-data pipeline over text and embedding tables.

Nothing else in the library imports this subpackage; it may be removed as a whole.
"""
