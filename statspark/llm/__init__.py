"""Operators for preparing training text at scale: cleaning, deduplication, mixing and packing."""
