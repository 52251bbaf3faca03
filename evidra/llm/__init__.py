"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Each ``opN`` module holds one
operator with its own general interface; ``queries`` registers the thin
contract queries and ``oracles`` their SQL.
"""
