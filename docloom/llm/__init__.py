"""Operators of a training-data pipeline: deduplication, mixing, search, scoring, filtering and packing."""
