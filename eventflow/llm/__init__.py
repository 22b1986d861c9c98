"""Operators that prepare training text: filtering, extraction, deduplication, counting, packing."""
