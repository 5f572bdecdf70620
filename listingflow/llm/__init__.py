"""Operators for large text corpora: deduplication, filters, tokens, mixing."""
