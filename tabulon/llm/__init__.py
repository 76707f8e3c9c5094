"""Operators for preparing training text: counting, filtering, near and exact copies, packing."""
