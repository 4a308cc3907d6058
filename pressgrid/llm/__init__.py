"""Operators that prepare training data: scoring, tokenising, de-duplication, packing.

Nothing else in the library imports this subpackage.
"""
