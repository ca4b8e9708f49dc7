"""Operators for large training corpora: dedup, packing, sharding, scans, quality and mixing.

Nothing outside this subpackage imports it; the queries are in ``meridia.llm.queries``.
"""
