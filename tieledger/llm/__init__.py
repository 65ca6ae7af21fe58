"""Operators that prepare training text: language, near copies, mixing, packing, personal data and more."""
