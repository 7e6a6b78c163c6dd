"""Operators of a training-data pipeline: rules, deduplication, mixing, tokens, formats, models.

Nothing else in the library imports this subpackage.
"""
