"""Operators for preparing training text: deduplication, scoring, masking, packing, formatting."""
