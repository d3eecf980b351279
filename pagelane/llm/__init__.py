"""Training-data operators: dedup, search, filtering, mixing, packing, web archives.

Nothing else in the library imports this subpackage.
"""
