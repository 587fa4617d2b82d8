"""Operators of a training-data pipeline over a table of documents: deduplication, privacy, filtering,
scoring, mixing. Nothing else in the library imports this package."""
