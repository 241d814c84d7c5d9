"""Streams: what the batch operators on series compute, over unbounded input."""
