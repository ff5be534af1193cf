"""Operators for corpora of training data: filtering, deduplication, search, tokens, packing."""
