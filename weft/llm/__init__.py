"""Operators for preparing training data: quality, deduplication, scoring, tokens."""
