"""Operators that prepare training text: extraction, filtering, deduplication, counting, packing and sharding."""
