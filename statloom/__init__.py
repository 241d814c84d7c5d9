"""Statloom: statistics, vectors, retrieval, series, sampling and transparent models as lazy Spark DataFrame plans."""

__version__ = "0.1.0"
