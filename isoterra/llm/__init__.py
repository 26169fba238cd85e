"""Training-data operators: deduplication, filtering, mixing, tokenising, packing and vector search.

Nothing outside this subpackage imports it.
"""
