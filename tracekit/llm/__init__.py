"""Operators for text corpora: search, fingerprints, mixing, duplicates, extraction, archives, models, tokens."""
