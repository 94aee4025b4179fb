"""Operators for large-scale training-data preparation.

Each module holds one operator with its own general interface; :mod:`plaint.llm.catalog`
registers one query per operator.  Nothing outside this package imports it.
"""
