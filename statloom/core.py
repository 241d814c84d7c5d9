"""Building blocks: guards, IEEE arithmetic, statistics as broadcast columns, and positions without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
#: Rows of a block of positions: what one task's window holds of a series without partitions.
BLOCK = 1 << 16


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def double(c: Column | str) -> Column:
    return col(c).cast("double")


def finite(c: Column | str) -> Column:
    x = double(c)
    return ~F.isnan(x) & (F.abs(x) != INF)


def all_finite(c: Column | str) -> Column:
    """Aggregate: whether no value is NaN or infinite (nulls are absent)."""
    return F.coalesce(F.bool_and(finite(c)), F.lit(True))


def ieee_log(c: Column | str) -> Column:
    """ln with -inf at 0 and NaN below, where Spark has null."""
    x = double(c)
    return F.when(x == 0, -INF).when((x < 0) | F.isnan(x), NAN).otherwise(F.log(x))


def ieee_log10(c: Column | str) -> Column:
    x = double(c)
    return F.when(x == 0, -INF).when((x < 0) | F.isnan(x), NAN).otherwise(F.log10(x))


def ieee_divide(a: Column | str, b: Column | str) -> Column:
    """a / b with the infinities and NaN of IEEE arithmetic, where Spark raises."""
    x, y = double(a), double(b)
    by_zero = F.when(F.isnan(x) | (x == 0), NAN).when(x > 0, INF).otherwise(-INF)
    return F.when(y == 0, by_zero).otherwise(F.try_divide(x, y))


def known_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")


def with_stats(df: DataFrame, **stats: Column) -> DataFrame:
    """df with whole-table aggregates as columns: one pass for the aggregates and a one-row broadcast, not a window of all rows."""
    return df.crossJoin(F.broadcast(df.agg(*(c.alias(n) for n, c in stats.items()))))


def bucket_of(value: Column, bounds: Sequence) -> Column:
    """How many of the sorted bounds are below value, found in two steps of about sqrt(len(bounds)) comparisons."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    rows = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    first = F.size(F.filter(F.array(*(F.lit(r[-1]) for r in rows)), lambda b: b < value))
    inner = F.get(F.array(*(F.array(*(F.lit(b) for b in r)) for r in rows)), first)
    return (first * step + F.coalesce(F.size(F.filter(inner, lambda b: b < value)), F.lit(0))).cast("int")


def joined(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """left and right joined on by, where null equals null; the columns of by come from left. Without by right is one row, or a few."""
    if not by:
        return left.join(F.broadcast(right), how=how) if how == "inner" else left.join(F.broadcast(right), F.lit(True), how)
    renamed = right.withColumnsRenamed({c: f"_right_{k}" for k, c in enumerate(by)})
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_right_{k}")) for k, c in enumerate(by)))
    return left.join(renamed, same, how).drop(*(f"_right_{k}" for k in range(len(by))))


def is_ordinal(df: DataFrame, order_by: str) -> bool:
    """Whether ranges of a column can be cut by numbers."""
    return df.schema[order_by].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal", "timestamp", "timestamp_ntz", "date") or df.schema[order_by].dataType.typeName().startswith("decimal")


def with_position(df: DataFrame, order_by: str, name: str = "position", by: Sequence[str] = ()) -> DataFrame:
    """df with each row's 0-based position, in its group of by, in the order of a numeric or time column without ties.

    The column's approximate quantiles cut the rows into ranges; positions are counted within these, and the ranges' sizes are
    added up over as many rows as there are ranges (of each group). So no window holds a whole group.
    """
    key = F.col(order_by)
    if df.schema[order_by].dataType.typeName() in ("timestamp", "timestamp_ntz", "date"):
        key = F.unix_micros(key.cast("timestamp"))
    elif df.schema[order_by].dataType.typeName() == "string":
        raise ValueError("order_by must be numeric or a time")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.select(key.alias("k")).agg(F.percentile_approx("k", [k / n for k in range(1, n)] or [0.5], 10000)).first()[0] or []
    ranged = df.withColumn("_place_range", bucket_of(key, sorted(set(cuts))))
    sizes = ranged.groupBy(*by, "_place_range").agg(F.count("*").alias("_place_size"))
    before = Window.partitionBy(*by).orderBy("_place_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "_place_range", F.coalesce(F.sum("_place_size").over(before), F.lit(0)).alias("_place_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_place_range").orderBy(order_by)) - 1
    counted = ranged.withColumn("_place_inside", inside)
    met = joined(counted, sizes, [*by, "_place_range"]) if by else counted.join(F.broadcast(sizes), "_place_range")
    return met.withColumn(name, (F.col("_place_before") + F.col("_place_inside")).cast("long")).drop("_place_range", "_place_before", "_place_inside")


def over_blocks(df: DataFrame, position: str, back: int, by: Sequence[str] = (), **columns) -> DataFrame:
    """df with columns computed by functions of a window that reaches up to ``back`` rows back in its group of by.

    Blocks of positions take the last ``back`` rows of the block before along, so no window holds a whole series.
    """
    size = max(BLOCK, back)
    block = F.floor(F.col(position) / size)
    carries = F.col(position) % size >= size - back if back else F.lit(False)
    both = df.withColumn("_halo_own", block).withColumn("_halo_block", F.explode(F.when(carries, F.array(block, block + 1)).otherwise(F.array(block))))
    window = Window.partitionBy(*by, "_halo_block").orderBy(position)
    done = both.withColumns({n: f(window) for n, f in columns.items()})
    return done.where("_halo_own = _halo_block").drop("_halo_own", "_halo_block")


def prefix_sums(df: DataFrame, position: str, x: Column, name: str, product: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """df with the running sum (or product) of x in the order of position, for each group of by: within blocks, and over the blocks' totals."""
    combine = F.product if product else F.sum
    neutral = F.lit(1.0 if product else 0.0)
    key = [*by, "_prefix_block"]
    blocked = df.withColumn("_prefix_block", F.floor(F.col(position) / BLOCK)).withColumn("_prefix_x", x)
    earlier = Window.partitionBy(*by).orderBy("_prefix_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy(*key).agg(combine("_prefix_x").alias("_prefix_total")).select(*key, F.coalesce(combine("_prefix_total").over(earlier), neutral).alias("_prefix_before"))
    inside = Window.partitionBy(*key).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    running = blocked.withColumn("_prefix_inside", combine("_prefix_x").over(inside))
    done = joined(running, totals, key) if by else running.join(totals, "_prefix_block")
    value = F.col("_prefix_before") * F.col("_prefix_inside") if product else F.col("_prefix_before") + F.col("_prefix_inside")
    return done.withColumn(name, value).drop("_prefix_block", "_prefix_x", "_prefix_inside", "_prefix_before")
