"""Operators for preparing training text: deduplication, cleaning, mixing and counting."""
