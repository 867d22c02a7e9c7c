"""Training-data operators: search, filters, packing, deduplication, extraction, language and mixing.

Nothing else in the library imports this subpackage.
"""
