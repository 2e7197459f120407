"""Operators for preparing training data: filters, deduplication, tokenization, packing."""
