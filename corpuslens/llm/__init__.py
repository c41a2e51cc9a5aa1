"""Training-data operators: deduplication, packing, mixing, classification, retrieval and licence scans.

Nothing outside this subpackage imports it.
"""
