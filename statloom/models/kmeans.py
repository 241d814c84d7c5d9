"""k-means by Lloyd's iterations: one aggregate a step of all models that are fitted together, centroids of the size of the model."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.core import with_position
from statloom.functions.vectors import arrow_matrix, as_doubles, literal
from statloom.models.base import Classifier

#: The linear congruential generator that the initial shuffle draws from.
LCG_FACTOR, LCG_STEP = 6364136223846793005, 1442695040888963407


#: Draws that are looked at at once.
DRAWS = 1 << 20


def _advanced(state: int, steps: int) -> int:
    """The generator's state after so many steps."""
    factor, step, total_factor, total_step = LCG_FACTOR, LCG_STEP, 1, 0
    while steps:
        if steps & 1:
            total_factor, total_step = total_factor * factor % (1 << 64), (total_step * factor + step) % (1 << 64)
        factor, step = factor * factor % (1 << 64), (factor + 1) * step % (1 << 64)
        steps >>= 1
    return (state * total_factor + total_step) % (1 << 64)


def initial_rows(n: int, k: int, seed: int) -> list[int]:
    """The first k positions of a Fisher-Yates shuffle of n, which from the last place i on swaps i with a drawn j <= i.

    Only k positions are followed, each back to where it came from: what is in a place before a step was put there by the step before it of
    the least i above that drew the place, and stood in i until then. Draws are made in blocks, so n may be large.
    """
    powers = np.full(min(n, DRAWS) + 1, LCG_FACTOR, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.zeros_like(powers)
    np.cumsum(powers[:-1], out=sums[1:])
    where: dict[int, list[int]] = {0: [0]}  # place: which of the wanted come from it
    for low in range(1, n, DRAWS):
        high = min(n, low + DRAWS)
        first = _advanced(seed % (1 << 64), n - high)  # before the draw of place high - 1
        m = np.arange(high - low, 0, -1)  # place low + x is drawn after this many further steps
        drawn = (np.uint64(first) * powers[m] + np.uint64(LCG_STEP) * sums[m]) % np.arange(low + 1, high + 1, dtype=np.uint64)
        for x in range(min(k, high) - low):  # the wanted places themselves take what they draw
            i, j = low + x, int(drawn[x])
            moved = where.pop(j, [])
            if moved:
                where.setdefault(i, []).extend(moved)
            where.setdefault(j, []).append(i)
        at = max(0, min(k, high) - low)
        while True:
            hits = np.flatnonzero(np.isin(drawn[at:], np.fromiter(where, np.uint64, len(where))))
            if not len(hits):
                break
            for x in (at + hits).tolist():  # places that were left for i are looked for only from i on
                j = int(drawn[x])
                if j in where and j != low + x:
                    where.setdefault(low + x, []).extend(where.pop(j))
                    at = x + 1
                    break
            else:
                break
    found = [0] * k
    for place, wanted in where.items():
        for w in wanted:
            found[w] = place
    return found


def squared_distance(x: Column, centroid: Column) -> Column:
    return F.aggregate(F.zip_with(x, centroid, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)


def nearest(x: Column, centroids) -> Column:
    """struct(distance, cluster) of the nearest centroid, the first of equals."""
    return F.array_min(F.array(*(F.struct(squared_distance(x, literal(c)).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids))))


@dataclass(frozen=True)
class KMeans(Classifier):
    centroids: tuple[tuple[float, ...], ...]
    inertia: float
    iterations: int

    @classmethod
    def fit(cls, df: DataFrame, features: str, k: int, order: str | None = None, iterations: int = 100, seed: int = 0, start: list[list[float]] | None = None) -> KMeans:
        """From k rows that the seed picks in the order of ``order``, or from given centroids; an empty cluster's centroid becomes zero.

        Ends when no centroid moves, or after the iterations.
        """
        with cls._held(df, features, order) as (rows, n):
            if not 1 <= k <= n:
                raise ValueError("k must be between 1 and the number of rows")
            if start is None and order is None:
                raise ValueError("an order of the rows is needed to pick the first centroids")
            return cls._fits(rows, cls._starts(rows, n, [(k, seed)]) if start is None else [start], iterations)[0]

    @staticmethod
    @contextmanager
    def _held(df: DataFrame, features: str, order: str | None) -> Iterator[tuple[DataFrame, int]]:
        """The vectors, persisted for several passes, with their positions in the order if one is given; and how many there are."""
        rows = df.select(as_doubles(features).alias("x"), *([F.col(order).alias("_o")] if order else [])).where("x is not null")
        if order:
            rows = with_position(rows, "_o", "p").select("x", "p")
        if rows.rdd.getNumPartitions() < rows.sparkSession.sparkContext.defaultParallelism:
            rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
        rows = rows.persist()
        try:
            yield rows, rows.count()
        finally:
            rows.unpersist()

    @staticmethod
    def _starts(rows: DataFrame, n: int, wanted: list[tuple[int, int]]) -> list[list[list[float]]]:
        """The first centroids for each (k, seed), read in one pass."""
        if any(not 1 <= k <= n for k, _ in wanted):
            raise ValueError("k must be between 1 and the number of rows")
        places = [initial_rows(n, k, seed) for k, seed in wanted]
        picked = {r["p"]: r["x"] for r in rows.where(F.col("p").isin(*set().union(*places))).select("p", "x").collect()}
        return [[picked[p] for p in own] for own in places]

    @classmethod
    def _fits(cls, rows: DataFrame, starts: list[list[list[float]]], iterations: int) -> list[KMeans]:
        """A model from each start; all that still move take their step in one pass over the rows."""
        centroids = [np.array(s, float) for s in starts]
        inertia, steps, moving = [0.0] * len(starts), [0] * len(starts), list(range(len(starts)))
        for done in range(1, iterations + 1):
            found, still = cls._step(rows, [centroids[i] for i in moving]), []
            for i, (moved, total) in zip(moving, found):
                inertia[i], steps[i] = total, done
                if not np.array_equal(moved, centroids[i]):
                    still.append(i)
                centroids[i] = moved
            moving = still
            if not moving:
                break
        if moving:
            for i, (_, total) in zip(moving, cls._step(rows, [centroids[i] for i in moving])):
                inertia[i] = total
        return [cls(tuple(map(tuple, c.tolist())), t, s) for c, t, s in zip(centroids, inertia, steps)]

    @staticmethod
    def _step(rows: DataFrame, models: list[np.ndarray]) -> list[tuple[np.ndarray, float]]:
        """For each model, the means of the rows nearest to each centroid, zeros where there are none, and the sum of squared distances to the nearest.

        A task adds up its rows and hands on one row a centroid: the sums, the number of rows, and the distances.
        """
        shipped = rows.sparkSession.sparkContext.broadcast(models)
        first = np.cumsum([0, *map(len, models)])
        size = models[0].shape[1]

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            added = np.zeros((first[-1], size + 2))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = arrow_matrix(batch.column("x"), size)
                for centroids, at in zip(shipped.value, first):
                    distance = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
                    cluster = distance.argmin(1)  # the first of equals
                    for k in range(len(centroids)):
                        own = cluster == k
                        added[at + k, :size] += x[own].sum(0)
                        added[at + k, size:] += own.sum(), distance[own, k].sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first[-1]), pa.int32()), pa.array(added.tolist(), pa.list_(pa.float64()))], ["c", "added"])

        parts = rows.select("x").mapInArrow(partial, "c int, added array<double>").select("c", F.posexplode("added").alias("j", "value"))
        whole = np.zeros((first[-1], size + 2))
        for r in parts.groupBy("c", "j").agg(F.sum("value").alias("value")).collect():
            whole[r["c"], r["j"]] = r["value"]
        shipped.unpersist()
        made = []
        for at, to in zip(first, first[1:]):
            sums, n = whole[at:to, :size], whole[at:to, size : size + 1]
            made.append((np.divide(sums, n, out=np.zeros_like(sums), where=n > 0), float(whole[at:to, size + 1].sum())))
        return made

    @classmethod
    def best_fit(cls, df: DataFrame, features: str, k: int, order: str, iterations: int = 100, attempts: int = 10) -> KMeans:
        """The least inertia of the seeds 0, 1, ..."""
        with cls._held(df, features, order) as (rows, n):
            return min(cls._fits(rows, cls._starts(rows, n, [(k, seed) for seed in range(attempts)]), iterations), key=lambda m: m.inertia)

    @classmethod
    def elbow(cls, df: DataFrame, features: str, ks: range, order: str, iterations: int = 100, seed: int = 0) -> list[tuple[int, float]]:
        """Inertia for each k."""
        with cls._held(df, features, order) as (rows, n):
            return [(k, m.inertia) for k, m in zip(ks, cls._fits(rows, cls._starts(rows, n, [(k, seed) for k in ks]), iterations))]

    def column(self, features: str) -> Column:
        return nearest(as_doubles(features), self.centroids)["cluster"]

    def predict(self, df: DataFrame, features: str, name: str = "cluster") -> DataFrame:
        return df.withColumn(name, self.column(features))

    def clusters(self, df: DataFrame, features: str) -> DataFrame:
        """(cluster, size) of the clusters that have rows."""
        return self.predict(df, features, "cluster").groupBy("cluster").agg(F.count("*").alias("size"))

    def members(self, df: DataFrame, features: str) -> DataFrame:
        """df's rows with cluster, centroid and squared distance to it."""
        near = nearest(as_doubles(features), self.centroids)
        placed = df.withColumn("_near", near).withColumn("cluster", F.col("_near.cluster")).withColumn("distance", F.col("_near.distance")).drop("_near")
        return placed.withColumn("centroid", F.get(F.array(*map(literal, self.centroids)), F.col("cluster")))

    def __str__(self) -> str:
        return f"KMeans: {len(self.centroids)} clusters, inertia {self.inertia:.4g}"
