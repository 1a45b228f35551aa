"""Operators for preparing large training corpora, one module per operator.

``queries`` holds the thin registered queries and their SQL. Nothing outside
this subpackage imports it.
"""
