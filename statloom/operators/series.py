"""Series in a given order: running and rolling values, differences, scaling, stacking and integrals.

``order`` is a column without ties. With ``by``, each group is a series, else the rows are one. A series of any length is taken in blocks of
positions, over which sums, lags and smoothed values are carried on. Groups that are all short (of a block at most), or whose order is
no number or time, are one window each.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from statloom import core
from statloom.core import double, is_ordinal, joined, over_blocks, prefix_sums, with_position, with_stats

#: A rolling window of more rows than this is compared with the series' lengths first, as each of its rows is read for every position.
WIDE = 1 << 10


def _short(df: DataFrame, order: str, by: tuple[str, ...]) -> bool:
    """Whether a plain window is enough for each group."""
    if not by:
        return False
    return not is_ordinal(df, order) or (df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) <= core.BLOCK


def _running(df: DataFrame, x: Column, order: str, by: tuple[str, ...], name: str, product: bool = False) -> DataFrame:
    if _short(df, order, by):
        window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, (F.product if product else F.sum)(x).over(window))
    return prefix_sums(with_position(df, order, "_position", by), "_position", x, name, product, by).drop("_position")


def _looking_back(df: DataFrame, order: str, by: tuple[str, ...], back: int, **columns) -> DataFrame:
    if _short(df, order, by):
        window = Window.partitionBy(*by).orderBy(order)
        return df.withColumns({n: f(window) for n, f in columns.items()})
    return over_blocks(with_position(df, order, "_position", by), "_position", back, by, **columns).drop("_position")


def cumulative_sum(df: DataFrame, x: str, order: str, by: tuple[str, ...] = (), name: str = "cumulative") -> DataFrame:
    return _running(df, double(x), order, by, name)


def cumulative_product(df: DataFrame, x: str, order: str, by: tuple[str, ...] = (), name: str = "cumulative") -> DataFrame:
    return _running(df, double(x), order, by, name, product=True)


def rolling_mean(df: DataFrame, x: str, order: str, window: int, by: tuple[str, ...] = (), name: str = "rolling") -> DataFrame:
    """Mean of the last ``window`` values, of fewer at the start; of the whole series if it is shorter; no rows if window < 1.

    A wide window that no series fills takes one aggregate and no window of rows.
    """
    if window < 1:
        return df.withColumn(name, F.lit(None).cast("double")).where(F.lit(False))
    whole = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.avg(double(x)).alias("_mean"))
    if window > WIDE and (whole.agg(F.max("_n")).first()[0] or 0) < window:
        return joined(df, whole, by).withColumn(name, F.col("_mean")).drop("_n", "_mean")
    made = _looking_back(df, order, by, window - 1, **{name: lambda w: F.avg(double(x)).over(w.rowsBetween(1 - window, 0))})
    return joined(made, whole, by).withColumn(name, F.when(F.col("_n") < window, F.col("_mean")).otherwise(F.col(name))).drop("_n", "_mean")


def exponential_mean(df: DataFrame, x: str, order: str, alpha: float | None = None, span: int | None = None, by: tuple[str, ...] = (), name: str = "smoothed") -> DataFrame:
    """s(0) = x(0), s(i) = alpha x(i) + (1 - alpha) s(i - 1); alpha = 2 / (span + 1) if span is given.

    Blocks of rows are smoothed on their own first; what a block hands on shrinks by a power of 1 - alpha, which links the blocks.
    """
    alpha = 2 / (span + 1) if alpha is None else alpha
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    keep = df.columns
    if _short(df, order, by):
        ordered = df.withColumn("_position", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
    else:
        ordered = with_position(df, order, "_position", by)
    ordered = ordered.withColumn("_block", F.floor(F.col("_position") / core.BLOCK))
    key = [*by, "_block"]
    schema = StructType([*ordered.schema.fields, StructField("_own", DoubleType()), StructField("_fade", DoubleType())])

    def smooth(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_position")
        v = rows[x].astype("float64")
        first = rows["_position"].iloc[0] == 0
        if first:
            own = v.ewm(alpha=alpha, adjust=False).mean()
        else:  # as if the value before were 0
            own = pd.concat([pd.Series([0.0]), v]).ewm(alpha=alpha, adjust=False).mean().iloc[1:]
        steps = pd.RangeIndex(1, len(rows) + 1).to_numpy()
        return rows.assign(_own=own.to_numpy(), _fade=0.0 if first else (1 - alpha) ** steps)

    parts = ordered.groupBy(*key).applyInPandas(smooth, schema)
    ends = parts.groupBy(*key).agg(F.max_by("_own", "_position").alias("end"), F.max_by("_fade", "_position").alias("fade"))

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_block")
        carried, before = 0.0, []
        for end, fade in zip(rows["end"], rows["fade"]):
            before.append(carried)
            carried = end + fade * carried
        return rows[key].assign(_carried=before)

    kinds = ", ".join(f"`{c}` {ordered.schema[c].dataType.simpleString()}" for c in key)
    carried = ends.groupBy(*(by or [F.lit(0).alias("_all")])).applyInPandas(link, f"{kinds}, _carried double")
    return joined(parts, carried, key).withColumn(name, F.col("_own") + F.col("_fade") * F.col("_carried")).select(*keep, name)


def diff(df: DataFrame, x: str, order: str, lag: int = 1, by: tuple[str, ...] = (), name: str = "diff") -> DataFrame:
    """x less the value ``lag`` rows before; the first rows, which have none, go, and all go if lag < 1."""
    if lag < 1:
        return df.withColumn(name, F.lit(None).cast("double")).where(F.lit(False))
    made = _looking_back(df, order, by, lag, _before=lambda w: F.lag(F.struct(double(x).alias("x")), lag).over(w))
    return made.where("_before is not null").withColumn(name, double(x) - F.col("_before.x")).drop("_before")


def derivative(df: DataFrame, x: str, order: str, dt: float, by: tuple[str, ...] = (), name: str = "derivative") -> DataFrame:
    """Differences over the spacing dt."""
    if dt == 0:
        raise ValueError("dt must not be 0")
    return diff(df, x, order, 1, by, name).withColumn(name, F.col(name) / F.lit(float(dt)))


def percent_change(df: DataFrame, x: str, order: str, lag: int = 1, by: tuple[str, ...] = (), name: str = "change") -> DataFrame:
    """Change in percent of the value ``lag`` rows before; 0 if that is 0."""
    if lag < 1:
        return df.withColumn(name, F.lit(None).cast("double")).where(F.lit(False))
    made = _looking_back(df, order, by, lag, _before=lambda w: F.lag(F.struct(double(x).alias("x")), lag).over(w))
    past = F.col("_before.x")
    change = F.when(past == 0, 0.0).otherwise(F.try_divide(double(x) - past, past) * 100)
    return made.where("_before is not null").withColumn(name, change).drop("_before")


def scaled(df: DataFrame, x: str, low: float, high: float, name: str = "scaled") -> DataFrame:
    """x moved to [low, high]; low if all values are one."""
    v = double(x)
    share = F.coalesce(F.try_divide(v - F.col("_min"), F.col("_max") - F.col("_min")), F.lit(0.0))
    return with_stats(df, _min=F.min(v), _max=F.max(v)).withColumn(name, F.lit(float(low)) + share * (high - low)).drop("_min", "_max")


def as_percentages(df: DataFrame, x: str, name: str = "percent") -> DataFrame:
    return with_stats(df, _all=F.sum(double(x))).withColumn(name, F.coalesce(F.try_divide(double(x) * 100, F.col("_all")), F.lit(0.0))).drop("_all")


def standardized(df: DataFrame, x: str, name: str = "standardized") -> DataFrame:
    """z-scores by the sample standard deviation; zeros without spread; no rows under two values."""
    v = double(x)
    made = with_stats(df, _n=F.count(v), _m=F.avg(v), _s=F.stddev_samp(v)).where("_n > 1")
    return made.withColumn(name, F.coalesce(F.try_divide(v - F.col("_m"), F.col("_s")), F.lit(0.0))).drop("_n", "_m", "_s")


def stacked_cumulative(df: DataFrame, series: str, position: str, x: str, name: str = "stacked") -> DataFrame:
    """Running totals over the series, for each position."""
    return df.withColumn(name, F.sum(double(x)).over(Window.partitionBy(position).orderBy(series).rowsBetween(Window.unboundedPreceding, 0)))


def stacked_percentage(df: DataFrame, series: str, position: str, x: str, name: str = "percent") -> DataFrame:
    """Each series' share in percent of its position's total; 0 if that is 0."""
    whole = F.sum(double(x)).over(Window.partitionBy(position))
    return df.withColumn(name, F.coalesce(F.try_divide(double(x) * 100, whole), F.lit(0.0)))


def _trapezoids(x: str, dt: float):
    return lambda w: (F.lag(double(x)).over(w) + double(x)) * (0.5 * dt)


def trapezoidal_integral(df: DataFrame, x: str, order: str, dt: float, by: tuple[str, ...] = ()) -> DataFrame:
    """``integral``; null under two values."""
    made = _looking_back(df, order, by, 1, _area=_trapezoids(x, dt))
    return made.groupBy(*by).agg(F.sum("_area").alias("integral"))


def cumulative_trapezoidal(df: DataFrame, x: str, order: str, dt: float, by: tuple[str, ...] = (), name: str = "integral") -> DataFrame:
    """The running integral, 0 at the start."""
    made = _looking_back(df, order, by, 1, _area=_trapezoids(x, dt))
    return _running(made, F.coalesce("_area", F.lit(0.0)), order, by, name).drop("_area")


def sorted_indices(df: DataFrame, x: str, order: str, name: str = "index") -> DataFrame:
    """(rank, index): positions in ``order`` of the values from the least on. x must be free of ties for a distributed ranking; ties
    are broken by order within the range of a value."""
    ordered = with_position(df.select(order, double(x).alias("_x")), order, name)
    counted = ordered.groupBy("_x").agg(F.count("*").alias("_n"))
    before = prefix_sums(with_position(counted, "_x", "_p"), "_p", F.col("_n").cast("double"), "_upto").select("_x", (F.col("_upto") - F.col("_n")).cast("long").alias("_less"))
    ties = F.row_number().over(Window.partitionBy("_x").orderBy(name)) - 1
    return ordered.join(before, "_x").select((F.col("_less") + ties).cast("long").alias("rank"), name)


