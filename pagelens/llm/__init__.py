"""Operators of a training-data pipeline, and one query for each (``queries.py``).

Nothing else in the library imports this package.
"""
