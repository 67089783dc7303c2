"""Operators for training data: near-duplicates, repeated lines, nearest vectors, splitting,
broken pairs, packing, leakage and language labels. Nothing outside this folder imports it."""
