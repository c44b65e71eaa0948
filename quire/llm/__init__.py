"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries`` derives the registered query of each from it.
"""
