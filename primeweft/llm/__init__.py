"""Operators that prepare text corpora for training language models.

Nothing else in the library imports this subpackage.  Each ``opN`` module holds
one operator with its own interface; ``queries`` registers the thin queries.
"""
