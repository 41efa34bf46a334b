"""Training-data operators: tokenising, packing, search, filtering, deduplication, scoring and mixing.

Nothing outside this subpackage imports it.
"""
