"""Grouped aggregation, frequencies, distinct values, class balance and contingency tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.core import double, with_stats
from statloom.operators.aggregates import total

METHODS = ("sum", "mean", "count", "min", "max", "percentage")


def _method(name: str, x: str) -> Column:
    if name not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    v = double(x)
    return {"sum": F.coalesce(F.sum(v), F.lit(0.0)), "percentage": F.coalesce(F.sum(v), F.lit(0.0)), "mean": F.avg(v), "count": F.count(v).cast("double"), "min": F.min(v), "max": F.max(v)}[name]


def group_by(df: DataFrame, category: str, x: str, method: str) -> DataFrame:
    """(category, value). percentage: a group's sum in percent of the sum of all groups' (unscaled if that is 0)."""
    made = df.groupBy(F.col(category).alias("category")).agg(_method(method, x).alias("value"))
    if method == "percentage":
        share = F.when(F.col("_all") == 0, F.col("value")).otherwise(F.try_divide(F.col("value") * 100, F.col("_all")))
        made = with_stats(made, _all=F.sum("value")).select("category", share.alias("value"))
    return made


def grouped_data(df: DataFrame, category: str, x: str, method: str) -> DataFrame:
    """group_by in ascending order of category."""
    return group_by(df, category, x, method).orderBy("category")


def downsample(df: DataFrame, position: str, x: str, factor: int, method: str) -> DataFrame:
    """(chunk, value) of each ``factor`` rows in a row; the last chunk may be shorter; percentage is a plain sum here."""
    if factor < 1:
        raise ValueError("factor must be positive")
    return df.groupBy(F.floor(F.col(position) / factor).cast("long").alias("chunk")).agg(_method(method, x).alias("value"))


def probability_of(df: DataFrame, x: str, value) -> DataFrame:
    """Share of the rows that equal value; 0 without rows."""
    return df.agg(F.coalesce(F.avg(F.when(F.col(x) == value, 1.0).otherwise(0.0)), F.lit(0.0)).alias("probability"))


def frequency_distribution(df: DataFrame, x: str) -> DataFrame:
    """(value, probability)."""
    counts = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("value")).agg(F.count("*").alias("_n"))
    return with_stats(counts, _all=F.sum("_n")).select("value", (F.col("_n") / F.col("_all")).alias("probability"))


def distinct_sorted(df: DataFrame, x: str) -> DataFrame:
    return df.select(x).where(F.col(x).isNotNull()).distinct().orderBy(x)


def distinct_counts(df: DataFrame, x: str) -> DataFrame:
    """(value, count) in ascending order of value."""
    return df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("value")).agg(F.count("*").alias("count")).orderBy("value")


def value_counts(df: DataFrame, x: str) -> DataFrame:
    """(value, count), the most frequent first, then in ascending order of value."""
    return distinct_counts(df, x).orderBy(F.desc("count"), "value")


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("count"))


def imbalance_ratio(df: DataFrame, label: str) -> DataFrame:
    """The largest class count over the smallest; null under two classes."""
    counts = class_distribution(df, label)
    return counts.agg(F.when(F.count("*") > 1, F.max("count") / F.min("count")).alias("ratio"))


def contingency(df: DataFrame, row: str, column: str, most: int = 1_000_000) -> DataFrame:
    """(row, column, count) of every pair of labels, absent pairs with 0; more than ``most`` pairs are refused (``contingency_margins`` has
    those that are there)."""
    seen = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(row).alias("row"), F.col(column).alias("column")).agg(F.count("*").alias("count"))
    rows, columns = seen.agg(F.count_distinct("row"), F.count_distinct("column")).first()
    if rows * columns > most:
        raise ValueError(f"{rows} x {columns} pairs of labels are more than {most}")
    grid = seen.select("row").distinct().crossJoin(F.broadcast(seen.select("column").distinct()))
    return grid.join(seen, ["row", "column"], "left").select("row", "column", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def contingency_margins(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts of the cells, rows, columns and of all (null labels), by one cube."""
    made = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).cube(F.col(row).alias("row"), F.col(column).alias("column"))
    return made.agg(F.count("*").alias("count"))


def row_totals(table: DataFrame) -> DataFrame:
    return table.groupBy("row").agg(F.sum("count").alias("count"))


def column_totals(table: DataFrame) -> DataFrame:
    return table.groupBy("column").agg(F.sum("count").alias("count"))


def grand_total(table: DataFrame) -> DataFrame:
    return table.agg(total("count").alias("count"))


def _share(table: DataFrame, *by: str) -> DataFrame:
    whole = F.sum("count").over(Window.partitionBy(*by)) if by else None
    if whole is None:
        table = with_stats(table, _all=F.sum("count"))
        whole = F.col("_all")
    return table.select("row", "column", F.coalesce(F.try_divide(F.col("count"), whole), F.lit(0.0)).alias("probability"))


def joint_distribution(table: DataFrame) -> DataFrame:
    """Each cell over the total; 0 if that is 0."""
    return _share(table)


def conditional_by_column(table: DataFrame) -> DataFrame:
    """P(row | column)."""
    return _share(table, "column")


def conditional_by_row(table: DataFrame) -> DataFrame:
    """P(column | row)."""
    return _share(table, "row")
