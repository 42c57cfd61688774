"""Operators of a training-data pipeline at corpus scale, one module for each.

Nothing outside this subpackage imports it; its queries are in
``tessera.llm.queries``.
"""
