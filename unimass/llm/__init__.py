"""Operators over text corpora for training data: counts, cleaning, search, scoring, packing."""
