"""Operators for training-data pipelines.

Nothing outside this subpackage imports it; its queries are in :mod:`arbora.llm.queries`.
"""
