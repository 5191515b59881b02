"""Training-data operators: packing, token counts, near-duplicates, archives, mixing, scans, search and classification.

Nothing else in the library imports this subpackage; it can be deleted as a whole.
"""
