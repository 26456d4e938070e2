"""Operators for building language-model training data.

Nothing outside this package imports it, and the package stands alone: each
module holds one operator, ``queries`` registers the queries over the tables.
"""
