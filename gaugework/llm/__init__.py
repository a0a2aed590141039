"""Operators of a training-data pipeline: packing, quality, tokens, near-duplicates, filters."""
