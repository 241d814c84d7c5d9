"""Streaming forms of the series operators: windowed aggregates with a watermark, and smoothing with a value of state a key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from statloom.operators.groups import METHODS


def windowed(stream: DataFrame, time: str, x: str, width: str, method: str, slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """(start, end, by, value) of tumbling or sliding windows; rows later than ``late`` behind the latest time are left out."""
    if method not in METHODS or method == "percentage":
        raise ValueError("method must be sum, mean, count, min or max")
    v = F.col(x).cast("double")
    aggregate = {"sum": F.sum(v), "mean": F.avg(v), "count": F.count(v).cast("double"), "min": F.min(v), "max": F.max(v)}[method]
    window = F.window(time, width, slide) if slide else F.window(time, width)
    made = stream.withWatermark(time, late).groupBy(window.alias("w"), *by).agg(aggregate.alias("value"))
    return made.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "value")


def sessions(stream: DataFrame, time: str, gap: str, by: tuple[str, ...], late: str = "10 minutes") -> DataFrame:
    """(start, end, by, count) of runs of rows that are at most ``gap`` apart."""
    made = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("count"))
    return made.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "count")


def exponential_mean(stream: DataFrame, key: str, order: str, x: str, alpha: float) -> DataFrame:
    """(key, order, smoothed) of every row: the rows of a micro-batch are taken in order, after those of the batches before."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}

    def smooth(names: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(parts).sort_values(order)
        value, out = state.get[0] if state.exists else None, []
        for v in rows[x].astype(float):
            value = v if value is None else alpha * v + (1 - alpha) * value
            out.append(value)
        state.update((value,))
        yield pd.DataFrame({key: names[0], order: rows[order].to_numpy(), "smoothed": out})

    schema = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, smoothed double"
    return stream.groupBy(key).applyInPandasWithState(smooth, schema, "value double", "append", GroupStateTimeout.NoTimeout)
