"""Operators for preparing training corpora, with their queries and check SQL.

Nothing else in the library imports this package.
"""
