"""Training-data operators: quality, de-duplication, tokens, scoring, search, archives, packing.

Nothing else in the library imports this subpackage.
"""
