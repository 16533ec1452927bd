"""Operators for training-data pipelines: filtering, deduplication, classification, mixing, sharding."""
