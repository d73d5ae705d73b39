"""Operators of a training-data pipeline: scans, classifiers, near duplicates, mixing, vector search."""
