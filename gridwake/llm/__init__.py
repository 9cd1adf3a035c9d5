"""Training-data operators: deduplication, fingerprints, extraction, packing, filtering and mixing.

Nothing outside this subpackage imports it; ``queries`` holds the registered queries.
"""
