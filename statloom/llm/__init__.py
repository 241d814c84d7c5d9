"""Operators of a training-data pipeline: scoring, filtering, matching, packing and formatting of documents."""
