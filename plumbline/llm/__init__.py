"""Operators of a training-data pipeline: quality, extraction, deduplication, packing, privacy."""
