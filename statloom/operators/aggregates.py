"""Scalar statistics as aggregate columns: sample statistics by default, null where a statistic is undefined.

Percentiles come in two forms, with the same values: as aggregate columns, which keep the distinct values of a group in one task, and as
functions of tables (``percentiles``, ``quartiles_by`` and all reports), which select them over the cluster from groups of any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.core import all_finite, col, double, joined, prefix_sums, with_position, with_stats
from statloom.operators.selection import order_statistics


def total(x: Column | str) -> Column:
    """Sum, 0 of nothing."""
    return F.coalesce(F.sum(col(x)), F.lit(0))


def product(x: Column | str) -> Column:
    """Product, 0 of nothing."""
    return F.coalesce(F.product(double(x)), F.lit(0.0))


def arg_min(x: Column | str, order: Column | str) -> Column:
    """Order value of the first minimum."""
    return F.min_by(col(order), F.struct(col(x), col(order)))


def arg_max(x: Column | str, order: Column | str) -> Column:
    """Order value of the first maximum."""
    return F.min_by(col(order), F.struct(-double(x), col(order)))


def mean(x: Column | str) -> Column:
    return F.avg(double(x))


def median(x: Column | str) -> Column:
    return F.percentile(double(x), 0.5)


def variance(x: Column | str, ddof: int = 1) -> Column:
    x = double(x)
    n = F.count(x)
    if ddof == 1:
        value = F.var_samp(x)
    elif ddof == 0:
        value = F.var_pop(x)
    else:
        value = F.try_divide(F.var_pop(x) * n, n - ddof)
    return F.when(n > ddof, value)


def standard_deviation(x: Column | str, ddof: int = 1) -> Column:
    return F.sqrt(variance(x, ddof))


def standard_error(x: Column | str, ddof: int = 1) -> Column:
    return F.try_divide(standard_deviation(x, ddof), F.sqrt(F.count(double(x))))


def z_score(value: float, x: Column | str, ddof: int = 1) -> Column:
    return F.try_divide(F.lit(float(value)) - mean(x), standard_deviation(x, ddof))


def skewness(x: Column | str, bias: bool = True) -> Column:
    """g1, or the adjusted form without bias; null under 3 values, with NaN or infinity, or without spread."""
    v, n = double(x), F.count(double(x))
    g1 = F.skewness(v)
    value = g1 if bias else F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2)
    return F.when((n >= 3) & all_finite(v) & (F.var_pop(v) > 0), value)


def kurtosis(x: Column | str, bias: bool = True) -> Column:
    """Excess g2, or the adjusted form without bias; null under 4 values, with NaN or infinity, or without spread."""
    v, n = double(x), F.count(double(x))
    g2 = F.kurtosis(v)
    value = g2 if bias else F.try_divide((n - 1) * ((n + 1) * g2 + 6), (n - 2) * (n - 3))
    return F.when((n >= 4) & all_finite(v) & (F.var_pop(v) > 0), value)


def percentile(x: Column | str, p: float) -> Column:
    """Type 7 percentile, p in 0 to 100; null outside, of nothing, or with NaN or infinity."""
    if not 0 <= p <= 100:
        return F.lit(None).cast("double")
    return F.when(all_finite(x), F.percentile(double(x), p / 100))


def percentiles(df: DataFrame, x: str, by: Sequence[str] = (), **wanted: float) -> DataFrame:
    """(by, a column for each wanted percentile): type 7, 0 to 100; null outside, of nothing, or with NaN or infinity."""
    inside = {name: p / 100 for name, p in wanted.items() if 0 <= p <= 100}
    found = order_statistics(df, x, list(inside.values()), by)
    places = {name: k for k, name in enumerate(inside)}
    return found.select(*by, *((F.get("values", F.lit(places[name])) if name in places else F.lit(None).cast("double")).alias(name) for name in wanted))


#: The shares of a five-number summary, and their names.
FIVE = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}


def quartiles_by(df: DataFrame, x: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, min, q1, median, q3, max, iqr); nulls of nothing, or with NaN or infinity."""
    found = order_statistics(df, x, list(FIVE.values()), by)
    made = found.select(*by, *(F.get("values", F.lit(k)).alias(name) for k, name in enumerate(FIVE)))
    return made.withColumn("iqr", F.col("q3") - F.col("q1"))


def percentile_interval_of(df: DataFrame, x: str, level: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """(by, lower, upper) of the central level of a bootstrap distribution."""
    if not 0 < level < 1:
        raise ValueError("level must be between 0 and 1")
    return percentiles(df, x, by, lower=50 * (1 - level), upper=100 - 50 * (1 - level))


def quartile_parts(x: Column | str) -> dict[str, Column]:
    q = F.percentile(double(x), [0.0, 0.25, 0.5, 0.75, 1.0])
    fine = all_finite(x)
    names = ("min", "q1", "median", "q3", "max")
    return {n: F.when(fine, F.get(q, F.lit(k))) for k, n in enumerate(names)} | {"iqr": F.when(fine, F.get(q, F.lit(3)) - F.get(q, F.lit(1)))}


def quartiles(x: Column | str) -> Column:
    """struct(min, q1, median, q3, max, iqr)."""
    return F.struct(*(c.alias(n) for n, c in quartile_parts(x).items()))


def bowley_skewness(x: Column | str) -> Column:
    q = quartile_parts(x)
    return F.try_divide(q["q3"] - 2 * q["median"] + q["q1"], q["iqr"])


#: Bands of skewness within which a coefficient counts as symmetric: of the moment, of the quartile coefficient.
MOMENT_BAND, BOWLEY_BAND = 0.5, 0.1


def skewness_agreement(moment: Column, bowley: Column) -> Column:
    """``agree`` if both coefficients have one verdict (left, none, right), ``direction`` if theirs are opposite, else ``mixed``."""

    def verdict(x: Column, band: float) -> Column:
        return F.when(F.abs(x) < band, 0).otherwise(F.signum(x).cast("int"))

    m, b = verdict(moment, MOMENT_BAND), verdict(bowley, BOWLEY_BAND)
    return F.when(moment.isNull() | bowley.isNull(), F.lit(None)).when(m == b, "agree").when(m * b < 0, "direction").otherwise("mixed")


def skewness_report(df: DataFrame, x: str, by: tuple[str, ...] = ()) -> DataFrame:
    """moment (without bias), bowley and their agreement, per group."""
    bowley = F.try_divide(F.col("q3") - 2 * F.col("median") + F.col("q1"), F.col("iqr")).alias("bowley")
    moments = df.groupBy(*by).agg(skewness(x, bias=False).alias("moment"))
    made = joined(moments, quartiles_by(df, x, by).select(*by, bowley), by, "left")
    return made.withColumn("agreement", skewness_agreement(F.col("moment"), F.col("bowley")))


def empirical_rule(df: DataFrame, x: str) -> DataFrame:
    """Shares of values within 1, 2 and 3 sample standard deviations of the mean; null under 2 values or without spread."""
    v = double(x)
    stats = with_stats(df.where(v.isNotNull()), _m=F.avg(v), _s=F.when(all_finite(v), F.stddev_samp(v)))
    share = {f"within{k}": F.when(F.max("_s") > 0, F.avg(F.when(F.abs(v - F.col("_m")) <= k * F.col("_s"), 1.0).otherwise(0.0))) for k in (1, 2, 3)}
    return stats.agg(*(c.alias(n) for n, c in share.items()))


def outlier_mask(df: DataFrame, x: str, threshold: float = 2.0, mean_value: float | None = None, deviation: float | None = None) -> DataFrame:
    """df with ``outlier``: more than threshold sample standard deviations (1 if undefined) from the mean."""
    v = double(x)
    stats = with_stats(df, _m=F.avg(v) if mean_value is None else F.max(F.lit(float(mean_value))), _s=F.stddev_samp(v) if deviation is None else F.max(F.lit(float(deviation))))
    far = F.abs(v - F.col("_m")) > threshold * F.coalesce("_s", F.lit(1.0))
    return stats.withColumn("outlier", far).drop("_m", "_s")


def mean_vector(df: DataFrame, v: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, position, mean) of the elements of vectors; nothing for groups whose vectors differ in length."""
    rows = df.where(F.col(v).isNotNull()).select(*by, F.size(v).alias("_n"), F.posexplode(v).alias("position", "_x"))
    made = rows.groupBy(*by, "position").agg(F.avg(double("_x")).alias("mean"), F.min("_n").alias("_low"), F.max("_n").alias("_high"))
    return made.where("_low = _high").drop("_low", "_high")


def percentile_interval(x: Column | str, level: float = 0.95) -> Column:
    """struct(lower, upper) of the central level of a bootstrap distribution."""
    if not 0 < level < 1:
        raise ValueError("level must be between 0 and 1")
    q = F.percentile(double(x), [(1 - level) / 2, 1 - (1 - level) / 2])
    fine = all_finite(x)
    return F.struct(F.when(fine, F.get(q, F.lit(0))).alias("lower"), F.when(fine, F.get(q, F.lit(1))).alias("upper"))


def modes(df: DataFrame, x: str) -> DataFrame:
    """Every most frequent value, and its count."""
    counts = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count("*").alias("count"))
    return with_stats(counts, _most=F.max("count")).where("count = _most").drop("_most")


def percentile_rank(value: float, x: Column | str) -> Column:
    """Share in percent of the values below value, and half of those equal to it; 0 of nothing."""
    v = double(x)
    below = F.sum(F.when(v < value, 1.0).when(v == value, 0.5).otherwise(0.0))
    return F.coalesce(F.try_divide(below * 100, F.count(v)), F.lit(0.0))


def percentile_ranks(df: DataFrame, x: str, name: str = "rank") -> DataFrame:
    """df with the mid-rank percentile of every value, from the counts of the distinct values."""
    counts = df.where(F.col(x).isNotNull()).groupBy(double(x).alias("_v")).agg(F.count("*").alias("_n"))
    below = prefix_sums(with_position(counts, "_v", "_p"), "_p", F.col("_n").cast("double"), "_upto")
    below = with_stats(below, _all=F.sum("_n")).select("_v", ((F.col("_upto") - F.col("_n") / 2) * 100 / F.col("_all")).alias(name))
    return df.withColumn("_v", double(x)).join(below, "_v", "left").drop("_v")


SUMMARY = ("count", "mean", "std", *FIVE, "iqr")


def summary(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, count, mean, std, min, q1, median, q3, max, iqr); null where undefined."""
    moments = df.groupBy(*by).agg(F.count(double(x)).alias("count"), mean(x).alias("mean"), standard_deviation(x).alias("std"))
    return joined(moments, quartiles_by(df, x, by), by, "left").select(*by, *SUMMARY)


def column_summary(df: DataFrame, x: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Nine fields; no row where the standard deviation is undefined or a value isn't finite."""
    return summary(df, x, by).where(F.col("std").isNotNull() & F.col("min").isNotNull())


def frame_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same nine fields of each column; what is undefined is 0."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("ordinal"), F.lit(c).alias("column"), double(c).alias("x")) for k, c in enumerate(columns)))).alias("s")).select("s.*")
    return summary(long, "x", ("ordinal", "column")).na.fill(0.0, list(SUMMARY[1:]))


describe = frame_summary

