"""Feature scaling: by population standard deviations, or to a range. Features are a vector column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.vectors import as_doubles, literal
from statloom.models.base import Jsonable


def vector_stats(df: DataFrame, features: str, *stats: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates of ``x`` for each position of the vectors, in order of position."""
    rows = df.select(*by, F.posexplode(as_doubles(features)).alias("position", "x"))
    return rows.groupBy(*by, "position").agg(*stats)


@dataclass(frozen=True)
class StandardScaler(Jsonable):
    """(x - mean) / sd with population sd; 0 for a feature without spread."""

    means: tuple[float, ...]
    deviations: tuple[float, ...]

    @classmethod
    def fit(cls, df: DataFrame, features: str) -> StandardScaler:
        rows = vector_stats(df, features, F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("position").collect()
        if not rows:
            raise ValueError("there are no rows to fit")
        return cls(tuple(r["m"] for r in rows), tuple(r["s"] for r in rows))

    def column(self, features: Column | str) -> Column:
        scales = F.arrays_zip(literal(self.means).alias("m"), literal(self.deviations).alias("s"))
        return F.zip_with(as_doubles(features), scales, lambda x, p: F.when(p["s"] > 0, F.try_divide(x - p["m"], p["s"])).otherwise(F.lit(0.0)))

    def transform(self, df: DataFrame, features: str, name: str = "scaled") -> DataFrame:
        return df.withColumn(name, self.column(features))

    def __str__(self) -> str:
        return f"StandardScaler: {len(self.means)} features"


@dataclass(frozen=True)
class FeatureScaler(Jsonable):
    """Each feature moved to [low, high]; low for a feature without spread."""

    minima: tuple[float, ...]
    maxima: tuple[float, ...]
    low: float = 0.0
    high: float = 1.0

    @classmethod
    def fit(cls, df: DataFrame, features: str, low: float = 0.0, high: float = 1.0) -> FeatureScaler:
        rows = vector_stats(df, features, F.min("x").alias("a"), F.max("x").alias("b")).orderBy("position").collect()
        if not rows:
            raise ValueError("there are no rows to fit")
        return cls(tuple(r["a"] for r in rows), tuple(r["b"] for r in rows), low, high)

    def column(self, features: Column | str) -> Column:
        scales = F.arrays_zip(literal(self.minima).alias("a"), literal(self.maxima).alias("b"))
        share = lambda x, p: F.coalesce(F.try_divide(x - p["a"], p["b"] - p["a"]), F.lit(0.0))
        return F.zip_with(as_doubles(features), scales, lambda x, p: F.lit(self.low) + share(x, p) * (self.high - self.low))

    def transform(self, df: DataFrame, features: str, name: str = "scaled") -> DataFrame:
        return df.withColumn(name, self.column(features))

    def __str__(self) -> str:
        return f"FeatureScaler: {len(self.minima)} features to [{self.low:g}, {self.high:g}]"
