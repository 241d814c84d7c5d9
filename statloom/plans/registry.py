"""Registered queries: name to function of (spark, folder), and name to the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, or another."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return register


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without negative zeros."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """df with all its doubles rounded, some to digits of their own."""
    return df.select(*(r(c, own.get(c, digits)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))
