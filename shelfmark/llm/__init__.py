"""Operators of a training-data pipeline: deduplication, filtering, mixing and formatting.

Each module holds one operator with its own general interface; ``queries`` binds them to
the given tables. Nothing else in the library imports this subpackage.
"""
