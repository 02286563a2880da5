"""Operators for training-data pipelines: duplicates, languages, mixing, packing and screening."""
