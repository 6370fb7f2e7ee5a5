"""Operators of a training-data pipeline: deduplication, search, scoring, masking, mixing and packing."""
