"""Operators for large text corpora: counting, tokenising, near-duplicates, filters, packing."""
