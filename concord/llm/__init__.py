"""Operators for preparing training data: near-duplicates, mixing, filters, scans and scoring.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when present.
"""
