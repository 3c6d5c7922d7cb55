"""Operators of a training-data pipeline: filtering, scoring, deduplication and encoding of texts."""
