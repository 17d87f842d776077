"""Operators of a training-data pipeline: search, de-duplication, mixing, packing, filters and extraction."""
