"""Training-data operators: counting, deduplication, search, masking, packing, scoring and encoding.

Nothing outside this subpackage imports it.
"""
