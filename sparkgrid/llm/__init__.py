"""Operators for preparing training text: scoring, deduplication, mixing, tokenizing, sharding.

Nothing else in the package imports this one.
"""
