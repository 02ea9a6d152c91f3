"""Operators of a training-data pipeline: tokenisation, search, filtering and deduplication of text corpora."""
