"""Corpus preparation operators: deduplication, scoring, filtering, mixing, encoding."""
