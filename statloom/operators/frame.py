"""Tables of named number columns: construction, selection, filters, order and text previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.core import double, known_columns
from statloom.session import kept


def from_columns(spark: SparkSession, columns: list[tuple[str, list[float]]] | dict[str, list[float]]) -> DataFrame:
    """A table with ``position``: of (name, values) pairs in their order, or of a dictionary in the order of names."""
    pairs = sorted(columns.items()) if isinstance(columns, dict) else list(columns)
    names = [n for n, _ in pairs]
    if not pairs or len(set(names)) != len(names) or len({len(v) for _, v in pairs}) != 1 or not pairs[0][1]:
        raise ValueError("columns need different names, one length, and at least one row")
    rows = [(k, *map(float, values)) for k, values in enumerate(zip(*(v for _, v in pairs)))]
    return spark.createDataFrame(rows, "position long, " + ", ".join(f"`{n}` double" for n in names))


def from_matrix(spark: SparkSession, matrix: list[list[float]], names: list[str]) -> DataFrame:
    if not matrix or len(matrix[0]) != len(names):
        raise ValueError("each column of the matrix needs a name")
    return from_columns(spark, [(n, [r[k] for r in matrix]) for k, n in enumerate(names)])


def from_vectors(df: DataFrame, v: str, names: list[str]) -> DataFrame:
    """One column for each element of a vector column."""
    return df.select(*(F.get(F.col(v), F.lit(k)).cast("double").alias(n) for k, n in enumerate(names)))


def to_panel(df: DataFrame, v: str, name: str = "values") -> DataFrame:
    """The elements of a vector column as rows of (position, name)."""
    return df.select(F.posexplode(v).alias("position", name))


def select(df: DataFrame, *names: str) -> DataFrame:
    known_columns(df, *names)
    return df.select(*names)


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def labels(x: str) -> Column:
    """Numbers as class labels, cut towards zero."""
    return F.col(x).cast("int")


def to_matrix(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    """df with a vector of the columns, in the given order."""
    known_columns(df, *columns)
    return df.withColumn(name, F.array(*(double(c) for c in columns)))


def filtered(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows where the predicate is true; it reaches the scan."""
    return df.where(predicate)


def greater(x: str, value: float) -> Column:
    """x > value, false for NaN."""
    return (F.col(x) > value) & ~F.isnan(double(x))


def greater_equal(x: str, value: float) -> Column:
    return (F.col(x) >= value) & ~F.isnan(double(x))


def less(x: str, value: float) -> Column:
    return F.col(x) < value


def less_equal(x: str, value: float) -> Column:
    return F.col(x) <= value


def equals(x: str, y: str) -> Column:
    """Equality of two columns, false for NaN."""
    return (F.col(x) == F.col(y)) & ~F.isnan(double(x))


def choose(mask: Column, a: Column, b: Column) -> Column:
    return F.when(mask, a).otherwise(b)


def sorted_by(df: DataFrame, column: str, order: str, ascending: bool = True) -> DataFrame:
    """The whole table by one column, ties in the order of ``order``, NaN last in either direction."""
    key = F.col(column).asc() if ascending else F.col(column).desc()
    return df.orderBy(F.isnan(double(column)).asc(), key, order)


def ranked(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """df with each row's 0-based position in the order of columns of any kind (names, or sort columns such as ``F.desc("x")``).

    Rows are dealt by ranges of all the order's columns together, so a value that many rows share is spread as far as the columns after it
    tell them apart; each range is sorted, and the ranges' sizes are added up. Nulls and NaN stand where Spark sorts them. Rows alike in all
    columns follow each other in any order. The rows are written once, as their places must not change between the count and their use.
    """
    keys = [F.col(c).asc() if isinstance(c, str) else c for c in order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = kept(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id()), "ranked")
    bits = 33  # of a row's number in its range, below the range's
    sizes = placed.groupBy(F.shiftright("_place", bits).alias("_range")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    sizes = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    joined = placed.withColumn("_range", F.shiftright("_place", bits)).join(F.broadcast(sizes), "_range")
    inside = F.col("_place") - F.shiftleft("_range", bits)
    return joined.withColumn(name, (F.col("_before") + inside).cast("long")).drop("_place", "_range", "_before")


def unique(df: DataFrame, column: str) -> DataFrame | None:
    """Distinct values in ascending order; None without such a column."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column) if column in df.columns else None


def top_indices(df: DataFrame, score: str, order: str, k: int, label: str | None = None) -> DataFrame:
    """(rank, order or label, score) of the k highest scores, ties in the order of ``order``."""
    best = df.orderBy(F.desc(score), order).limit(max(0, k))
    rank = F.row_number().over(Window.orderBy(F.desc(score), order))  # over k rows
    return best.select(rank.cast("long").alias("rank"), F.col(label or order), F.col(score))


def describe_text(df: DataFrame) -> str:
    rows, columns = shape(df)
    return f"Panel: {columns} columns, {rows} rows"


def head(df: DataFrame, order: str, columns: list[str], n: int = 10) -> str:
    """The first n rows as aligned text with their positions."""
    rows = df.orderBy(order).limit(n).select(*columns).collect()
    return _text(columns, [tuple(r) for r in rows], 0)


def tail(df: DataFrame, order: str, columns: list[str], n: int = 10) -> str:
    """The last n rows as aligned text with their positions."""
    rows = df.orderBy(F.desc(order)).limit(n).select(*columns).collect()[::-1]
    return _text(columns, [tuple(r) for r in rows], df.count() - len(rows))


def _text(columns: list[str], rows: list[tuple], first: int) -> str:
    cells = [["", *columns]] + [[str(first + k), *(f"{x:.1f}" if x is not None else "" for x in r)] for k, r in enumerate(rows)]
    width = [max(len(r[k]) for r in cells) for k in range(len(columns) + 1)]
    return "\n".join("  ".join(x.rjust(w) for x, w in zip(r, width)) for r in cells)
