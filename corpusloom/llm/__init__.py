"""Operators for preparing training data, one module each.

Nothing else in the library imports this subpackage; ``queries.py`` registers its queries.
"""
