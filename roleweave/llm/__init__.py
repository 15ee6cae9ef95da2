"""Operators for building training data: scoring, archives, cleaning, deduplication, mixing, sharding and search."""
