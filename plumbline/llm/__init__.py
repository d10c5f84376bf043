"""Operators for preparing training data: extraction, filters, deduplication, tokens, packing, search."""
