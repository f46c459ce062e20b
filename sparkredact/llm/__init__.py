"""Operators for large training-data pipelines, with the queries that apply them.

Nothing else in the library imports this subpackage.
"""
