"""Operators that prepare training text: filtering, near-duplicates, extraction, media, packing, archives, scoring.

Nothing outside this subpackage imports it.
"""
