"""Operators for preparing training data: search, rules, packing, near-duplicates, mixing.

Nothing outside this subpackage imports it.
"""
