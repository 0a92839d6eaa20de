"""Operators for preparing training data: one module for each operator.

Nothing outside this subpackage imports it.  ``catalog`` lists its queries and SQL.
"""
