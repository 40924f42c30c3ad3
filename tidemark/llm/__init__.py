"""Operators for preparing training corpora: filters, near-duplicates, sharding, search, packing, tokens."""
