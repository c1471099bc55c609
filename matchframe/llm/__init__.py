"""Operators for large training-data corpora: scoring, filtering, deduplication, packing, sharding."""
