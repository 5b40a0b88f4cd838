"""Operators for training-data pipelines: mixing, deduplication, packing, classification, archives."""
