"""Operators of a training-data pipeline: scoring, deduplication, tokens, packing, chat text."""
