"""Training-data operators: deduplication, filtering, mixing, sharding, packing, search.

Nothing else in the library imports this subpackage.
"""
