"""Operators that prepare training data: scoring, mixing, deduplication, packing, archives."""
