"""Corpus operators for training data: filters, duplicates, search, mixing, tokens."""
