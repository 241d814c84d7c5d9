"""Generated series: ranges, waves and seeded random numbers, as rows (position, x); and a small driver-side generator."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions.vectors import arange, full, linspace


def _rows(spark: SparkSession, n: int, x) -> DataFrame:
    if n < 0:
        raise ValueError("the count must not be negative")
    return spark.range(n).select(F.col("id").alias("position"), x.alias("x"))


def constant(spark: SparkSession, n: int, value: float = 0.0) -> DataFrame:
    return _rows(spark, n, F.lit(float(value)))


def sine_wave(spark: SparkSession, frequency: float, sample_rate: float, n: int, amplitude: float = 1.0, offset: float = 0.0) -> DataFrame:
    return _rows(spark, n, F.lit(float(offset)) + F.lit(float(amplitude)) * F.sin(F.lit(2 * math.pi * frequency) * F.col("id") / F.lit(float(sample_rate))))


def uniform(spark: SparkSession, n: int, low: float = 0.0, high: float = 1.0, seed: int = 0) -> DataFrame:
    return _rows(spark, n, F.lit(float(low)) + F.rand(seed) * (high - low))


def normal(spark: SparkSession, n: int, mean: float = 0.0, sd: float = 1.0, seed: int = 0) -> DataFrame:
    return _rows(spark, n, F.lit(float(mean)) + F.randn(seed) * F.lit(float(sd)))


def exponential(spark: SparkSession, n: int, rate: float = 1.0, seed: int = 0) -> DataFrame:
    if rate <= 0:
        raise ValueError("rate must be positive")
    return _rows(spark, n, -F.log1p(-F.rand(seed)) / F.lit(float(rate)))


def binomial(spark: SparkSession, n: int, trials: int, p: float, seed: int = 0) -> DataFrame:
    """Successes of ``trials`` draws each, as doubles."""
    if trials < 0 or not 0 <= p <= 1:
        raise ValueError("trials must not be negative and p must be in [0, 1]")
    draws = spark.range(n * max(1, trials)).select(F.floor(F.col("id") / max(1, trials)).cast("long").alias("position"), (F.rand(seed) < p).cast("double").alias("hit"))
    return draws.groupBy("position").agg((F.sum("hit") if trials else F.lit(0.0)).alias("x"))


def integers(spark: SparkSession, n: int, low: int, high: int, seed: int = 0) -> DataFrame:
    """Whole numbers from low to high - 1."""
    if high <= low:
        raise ValueError("high must be above low")
    return _rows(spark, n, F.floor(F.lit(low) + F.rand(seed) * (high - low)).cast("long"))


def matrix(spark: SparkSession, rows: int, columns: int, seed: int = 0, kind: str = "uniform") -> DataFrame:
    """Rows (position, v): vectors of uniform or normal numbers."""
    draw = F.rand if kind == "uniform" else F.randn
    return spark.range(rows).select(F.col("id").alias("position"), F.array(*(draw(seed + j) for j in range(columns))).alias("v"))


class Xorshift:
    """A seeded 64-bit xorshift generator for loops on the driver; a seed of 0 counts as 1."""

    #: The shifts.
    SHIFTS = (13, 7, 17)

    def __init__(self, seed: int):
        self.state = seed % (1 << 64) or 1

    def next(self) -> int:
        a, b, c = self.SHIFTS
        x = self.state
        x ^= x << a & (1 << 64) - 1
        x ^= x >> b
        x ^= x << c & (1 << 64) - 1
        self.state = x
        return x

    def unit(self) -> float:
        return (self.next() >> 11) / (1 << 53)


__all__ = ["Xorshift", "arange", "binomial", "constant", "exponential", "full", "integers", "linspace", "matrix", "normal", "sine_wave", "uniform"]
