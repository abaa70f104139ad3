"""Operators for preparing training data at scale.

Nothing outside this package imports it.  Each operator module holds one operator
with a general interface; ``queries`` derives the fixed digest columns from it.
"""
