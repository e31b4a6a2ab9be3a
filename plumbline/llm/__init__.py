"""Operators of a training-data pipeline: deduplication, packing, tokens, language, quality, sharding and search."""
