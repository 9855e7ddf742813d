"""Training-data operators: packing, near-duplicate joins, scans, filters, mixing and tokenization.

Nothing else in the library imports this subpackage; ``entry.py`` here registers its queries.
"""
