"""Pearson correlation: of two columns, and of all pairs of columns in one pass over centred values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.core import double, with_stats


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """``correlation``; null of nothing or without spread."""
    a, b = double(x), double(y)
    both = with_stats(df.where(a.isNotNull() & b.isNotNull()), _mx=F.avg(a), _my=F.avg(b))
    u, v = a - F.col("_mx"), b - F.col("_my")
    return both.agg(_ratio(F.sum(u * v), F.sum(u * u), F.sum(v * v)).alias("correlation"))


def _ratio(xy: Column, xx: Column, yy: Column) -> Column:
    return F.try_divide(xy, F.sqrt(xx) * F.sqrt(yy))


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, value) for all pairs of columns: 1 on the diagonal, NaN without spread. Rows with a null are left out.

    Each pair of different columns is summed once; the mirror image is a projection of the one-row result.
    """
    rows = df.select(*(double(c).alias(c) for c in columns)).na.drop()
    centred = with_stats(rows, **{f"_m{k}": F.avg(c) for k, c in enumerate(columns)})
    at = [F.col(c) - F.col(f"_m{k}") for k, c in enumerate(columns)]
    sums = {(i, j): F.sum(at[i] * at[j]) for i in range(len(columns)) for j in range(i, len(columns))}
    one = centred.agg(*(s.alias(f"s{i}_{j}") for (i, j), s in sums.items()))
    cells = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            r = F.lit(1.0) if i == j else F.coalesce(_ratio(F.col(f"s{min(i, j)}_{max(i, j)}"), F.col(f"s{i}_{i}"), F.col(f"s{j}_{j}")), F.lit(float("nan")))
            cells.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), r.alias("value")))
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def heatmap(df: DataFrame, columns: list[str], labels: list[str] | None = None) -> DataFrame:
    """correlation_pairs with labels for the columns."""
    if labels is None:
        return correlation_pairs(df, columns)
    if len(labels) != len(columns):
        raise ValueError("each column needs a label")
    return correlation_pairs(df.select(*(F.col(c).alias(n) for c, n in zip(columns, labels))), list(labels))


def correlation_matrix(df: DataFrame, columns: list[str]) -> tuple[list[str], list[list[float]]]:
    """The matrix as a value on the driver: as many numbers as pairs of columns."""
    found = {(r["x"], r["y"]): r["value"] for r in correlation_pairs(df, columns).collect()}
    return columns, [[found[a, b] for b in columns] for a in columns]
