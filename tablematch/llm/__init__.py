"""Operators for training-data corpora: duplicates, quality, mixing, packing, language models, web archives."""
