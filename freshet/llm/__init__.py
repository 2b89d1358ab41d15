"""Operators for preparing training text: deduplication, search, packing, scoring, mixing."""
