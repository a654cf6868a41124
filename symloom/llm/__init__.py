"""Operators for preparing training corpora.

Nothing outside this subpackage imports it, so it can be removed without
touching the symbol-graph engine.
"""
