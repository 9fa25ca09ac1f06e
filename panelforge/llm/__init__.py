"""Operators of a training-data pipeline: search, tokens, scoring, dedup, mixing, packing."""
