"""Operators for large training-text corpora: dedup, filters, mixing, tokens, archives, search."""
