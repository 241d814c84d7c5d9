"""Equal-width histograms with kept empty bins, and rules for the number of bins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.core import all_finite, double
from statloom.operators.selection import order_statistics

RULES = ("square_root", "sturges", "freedman_diaconis")


def bin_count(rule: str, n: int, low: float, high: float, iqr: float) -> int:
    """Bins by rule; Freedman and Diaconis' rule without an interquartile range is Sturges'."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    if n < 1:
        return 0
    if high == low:
        return 1
    if rule == "square_root":
        return math.ceil(math.sqrt(n))
    width = 2 * iqr / n ** (1 / 3)
    if rule == "sturges" or width <= 0:
        return math.ceil(math.log2(n) + 1)
    return math.ceil((high - low) / width)


def histogram(df: DataFrame, x: str, bins: int | str) -> DataFrame:
    """(bin, midpoint, count), empty bins too. One bin if all values are one; no rows without values, or with NaN or infinity.

    bins: a number, or the name of a rule. The number of bins is known before the second pass, so the bins are rows of a range.
    """
    v = double(x)
    if bins == "freedman_diaconis":
        found = order_statistics(df, v, [0.0, 0.25, 0.75, 1.0]).first()
        low, q1, q3, high = found["values"]
        stats = {"n": found["n"], "fine": found["fine"], "low": low, "high": high, "iqr": q3 - q1 if low is not None else 0.0}
    else:
        stats = df.agg(F.count(v).alias("n"), all_finite(v).alias("fine"), F.min(v).alias("low"), F.max(v).alias("high"), F.lit(0.0).alias("iqr")).first()
    spark = df.sparkSession
    if not stats["n"] or not stats["fine"] or bins == 0 or not isinstance(bins, str) and bins < 0:
        return spark.createDataFrame([], "bin long, midpoint double, count long")
    low, high = stats["low"], stats["high"]
    if isinstance(bins, str):
        bins = bin_count(bins, stats["n"], low, high, stats["iqr"])
    if low == high:
        bins = 1
    width = (high - low) / bins
    place = F.least(F.floor((v - low) / width), F.lit(bins - 1)) if width else F.lit(0)
    counts = df.where(v.isNotNull()).groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("count"))
    every = spark.range(bins).select(F.col("id").alias("bin"), (F.lit(low) + width * (F.col("id") + 0.5)).alias("midpoint"))
    return every.join(counts, "bin", "left").select("bin", "midpoint", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
