"""Operators for preparing training corpora: deduplication, filtering, scoring, sharding, packing."""
