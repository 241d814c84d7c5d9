"""k nearest neighbours by exact search: queries against all training rows, in blocks of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from statloom.functions.vectors import arrow_matrix, as_doubles, normalized

METRICS, WEIGHTS = ("euclidean", "cosine"), ("uniform", "distance")
#: Bytes of a block of queries that are sent to every executor at once.
BLOCK_BYTES = 64 << 20
#: Distances that one pass computes, about what a core's cache holds.
TILE = 1 << 18
#: A cosine distance below this is none.
SAME = 1e-12


@dataclass(frozen=True)
class KNearestNeighbours:
    """The training rows themselves (a DataFrame of id, features, label), and how to vote."""

    train: DataFrame
    id: str
    features: str
    label: str
    k: int = 3
    metric: str = "euclidean"
    weight: str = "uniform"

    @classmethod
    def fit(cls, train: DataFrame, id: str, features: str, label: str, k: int = 3, metric: str = "euclidean", weight: str = "uniform") -> KNearestNeighbours:
        if metric not in METRICS or weight not in WEIGHTS:
            raise ValueError(f"metric must be one of {METRICS}, weight one of {WEIGHTS}")
        if not 1 <= k <= train.count():
            raise ValueError("k must be between 1 and the number of training rows")
        return cls(train, id, features, label, k, metric, weight)

    def neighbours(self, queries: DataFrame, id: str, features: str) -> DataFrame:
        """(query, neighbour, label, distance) of the k nearest training rows; ties go to the least id, a distance that is NaN comes last.

        Queries of BLOCK_BYTES in all are broadcast as a matrix, and the training rows stream past them where they are. More queries are dealt
        by blocks of so many bytes, each to a number of tasks that share the training rows, which a shuffle brings to every block. Either way the
        training rows are spread over all cores, and a task gives the k nearest of its own to each query. All pairs are compared. Null vectors are no queries and no neighbours, training rows of
        another length than the queries are no neighbours, and queries of different lengths raise.
        """
        vector = normalized if self.metric == "cosine" else as_doubles
        rows = self.train.select(F.col(self.id).alias("neighbour"), F.col(self.label).alias("label"), vector(self.features).alias("b"))
        asked = queries.select(F.col(id).alias("query"), vector(features).alias("a")).where("a is not null")
        kinds = {"query": asked.schema["query"].dataType, "neighbour": rows.schema["neighbour"].dataType, "label": rows.schema["label"].dataType, "distance": DoubleType()}
        schema = StructType([StructField(name, kind) for name, kind in kinds.items()])
        found = asked.agg(F.min(F.size("a")).alias("least"), F.max(F.size("a")).alias("size"), F.coalesce(F.sum(F.size("a") * 8 + 32), F.lit(0)).alias("bytes")).first()
        if not found["size"]:
            return asked.sparkSession.createDataFrame([], schema)
        if found["least"] != found["size"]:
            raise ValueError("queries differ in length")
        size, blocks = found["size"], max(1, -(-found["bytes"] // BLOCK_BYTES))
        rows = rows.where(F.size("b") == size)
        if blocks == 1:
            block = asked.toArrow().combine_chunks()
            shipped = rows.sparkSession.sparkContext.broadcast((block["query"].combine_chunks(), arrow_matrix(block["a"].combine_chunks(), size)))
            spread = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "neighbour")  # a file may be one piece, however many rows it has
            near = spread.mapInArrow(_nearest(shipped, size, self.k, self.metric), schema)
        else:
            near = _met(asked, rows, blocks).mapInArrow(_nearest_of_blocks(size, self.k, self.metric), schema)
        rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
        return near.withColumn("_rank", rank).where(F.col("_rank") <= self.k).drop("_rank")

    def predict(self, queries: DataFrame, id: str, features: str) -> DataFrame:
        """(query, predicted): the label with most votes, the least of equals. By distance, exact matches outvote all others."""
        near = self.neighbours(queries, id, features)
        if self.weight == "uniform":
            votes = near.groupBy("query", "label").agg(F.count("*").cast("double").alias("vote"))
        else:
            exact = F.max(F.when(F.col("distance") == 0, 1).otherwise(0)).over(Window.partitionBy("query"))
            vote = F.when(F.col("_exact") == 1, F.when(F.col("distance") == 0, 1.0).otherwise(0.0)).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
            votes = near.withColumn("_exact", exact).groupBy("query", "label").agg(F.sum(vote).alias("vote"))
        return votes.groupBy("query").agg(F.min_by("label", F.struct((-F.col("vote")).alias("v"), "label")).alias("predicted"))

    def save(self, path: str) -> None:
        """The training rows as Parquet under path, and how to vote beside them, as one row."""
        options = {"id": self.id, "features": self.features, "label": self.label, "k": self.k, "metric": self.metric, "weight": self.weight}
        self.train.select(self.id, self.features, self.label).write.parquet(f"{path}/rows")
        self.train.sparkSession.createDataFrame([options]).coalesce(1).write.json(f"{path}/options")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KNearestNeighbours:
        options = spark.read.json(f"{path}/options").first().asDict()
        return cls(spark.read.parquet(f"{path}/rows"), **options)

    def __str__(self) -> str:
        return f"KNearestNeighbours: k = {self.k}, {self.metric}, {self.weight}"


def _met(asked: DataFrame, rows: DataFrame, blocks: int) -> DataFrame:
    """Queries and training rows by block of queries and share of training rows, queries first; each such pair is a partition of its own."""
    shares = max(1, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    own = asked.select(F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block"), every(shares).alias("share"), F.lit(False).alias("guest"), F.col("a").alias("v"), "query", none(rows, "neighbour"), none(rows, "label"))
    guests = rows.select(every(blocks).alias("block"), F.pmod(F.xxhash64("neighbour"), F.lit(shares)).alias("share"), F.lit(True).alias("guest"), F.col("b").alias("v"), none(asked, "query"), "neighbour", "label")
    place = (F.col("block") * shares + F.col("share")).cast("int")
    return own.unionByName(guests).repartitionById(blocks * shares, place).sortWithinPartitions("block", "share", "guest")


def _first(k: int, query: np.ndarray, distance: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of each query's first k by distance, NaN last, then rank; sorted by query."""
    order = np.lexsort((rank, distance, query))
    sorted_ = query[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) if len(order) else np.zeros(0, bool)
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(new, at, 0)) < k]


class _Near:
    """The k nearest to each query of the rows offered, the least id of equals.

    A product of matrices gives all distances but for rounding, and rules out pairs that are further than k rows met before by more than its error.
    The others' distances are added up component by component, so that equal vectors are at equal distances in any batch.
    """

    def __init__(self, ids: pa.Array, block: np.ndarray, k: int, metric: str):
        self.ids, self.block, self.k, self.metric = ids, block, k, metric
        self.square = np.square(block).sum(1)
        self.furthest = np.full(len(block), np.inf)
        self.query, self.distance = np.zeros(0, np.int64), np.zeros(0)
        self.neighbour = self.label = None

    def _distances(self, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of queries i and rows j."""
        out = np.empty(len(i))
        step = max(1, TILE // self.block.shape[1])
        for at in range(0, len(i), step):
            own, other = rows[j[at : at + step]], self.block[i[at : at + step]]
            parts = own * other if self.metric == "cosine" else np.square(own - other)
            out[at : at + step] = np.cumsum(parts, axis=1)[:, -1]  # in order, where a sum goes by pairs
        if self.metric == "cosine":  # of unit vectors; a zero vector is at distance 1, and rounding errors are none
            return np.where(1 - out < SAME, 0.0, 1 - out)
        return np.sqrt(out)

    def _candidates(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of query and row that may be among the k nearest; all those of a query come at once."""
        size, cosine = self.block.shape[1], self.metric == "cosine"
        square = np.square(rows).sum(1)
        error = 8 * (size + 4) * np.finfo(float).eps
        right = -rows.T if cosine else np.vstack([-2 * rows.T, square])
        largest = square[np.isfinite(square)].max(initial=0.0)
        step = max(1, TILE // len(rows))
        for at in range(0, len(self.block), step):
            own = self.block[at : at + step]
            furthest, norm = self.furthest[at : at + step], self.square[at : at + step]
            if cosine:
                value, margin, limit = own @ right, np.full(len(own), error), np.maximum(furthest, SAME) - 1
            else:
                value, margin = np.hstack([own, np.ones((len(own), 1))]) @ right, error * (norm + largest)
                limit = np.square(furthest) * (1 + error) - norm
            limit = limit + margin
            new = np.flatnonzero(np.isinf(furthest))
            if len(new) and len(rows) >= self.k:  # nothing is known yet: the k nearest of these rows
                kth = np.partition(value[new], self.k - 1, axis=1)[:, self.k - 1]
                limit[new] = (np.maximum(kth, SAME - 1) if cosine else kth) + 2 * margin[new]
            i, j = np.divmod(np.flatnonzero(~(value > limit[:, None])), len(rows))
            if len(i):
                yield i + at, j

    def offer(self, rows: np.ndarray, neighbour: pa.Array, label: pa.Array) -> None:
        if not len(rows):
            return
        rank = pc.rank(neighbour, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        query, distance, row = [], [], []

        def settle(pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
            i, j = (np.concatenate(x) for x in zip(*pairs))
            found = self._distances(rows, i, j)
            best = _first(self.k, i, found, rank[j])
            query.append(i[best])
            distance.append(found[best])
            row.append(j[best])

        with np.errstate(all="ignore"):
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for pair in self._candidates(rows):
                held.append(pair)
                if sum(len(i) for i, _ in held) >= TILE:
                    settle(held)
                    held = []
            if held:
                settle(held)
        if query:
            at = pa.array(np.concatenate(row))
            self._keep(np.concatenate(query), np.concatenate(distance), neighbour.take(at), label.take(at))

    def _keep(self, query: np.ndarray, distance: np.ndarray, neighbour: pa.Array, label: pa.Array) -> None:
        """Takes rows among the nearest so far."""
        if self.neighbour is not None:
            query, distance = np.concatenate([self.query, query]), np.concatenate([self.distance, distance])
            neighbour, label = pa.concat_arrays([self.neighbour, neighbour]), pa.concat_arrays([self.label, label])
        rank = pc.rank(neighbour, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        best = _first(self.k, query, distance, rank)
        self.query, self.distance = query[best], distance[best]
        self.neighbour, self.label = neighbour.take(pa.array(best)), label.take(pa.array(best))
        last = np.flatnonzero(np.append(self.query[1:] != self.query[:-1], True))
        full = np.diff(last, prepend=-1) == self.k
        self.furthest[self.query[last[full]]] = np.where(np.isnan(self.distance[last[full]]), np.inf, self.distance[last[full]])

    def nearest(self) -> Iterator[pa.RecordBatch]:
        if self.neighbour is not None:
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(self.query)), self.neighbour, self.label, pa.array(self.distance)], ["query", "neighbour", "label", "distance"])


def _nearest(shipped: Broadcast, size: int, k: int, metric: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = _Near(*shipped.value, k, metric)
        for batch in batches:
            near.offer(arrow_matrix(batch.column("b"), size), batch.column("neighbour"), batch.column("label"))
        yield from near.nearest()

    return run


def _nearest_of_blocks(size: int, k: int, metric: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same for rows that come sorted by block and share, queries first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries, near = None, [], None
        for batch in batches:
            block, share, guest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "share", "guest"))
            cut = np.flatnonzero((np.diff(block) != 0) | (np.diff(share) != 0) | (np.diff(guest.astype(int)) != 0)) + 1
            for at, to in zip([0, *cut.tolist()], [*cut.tolist(), len(block)]):
                if to == at:
                    continue
                if key != (block[at], share[at]):
                    if near:
                        yield from near.nearest()
                    key, queries, near = (block[at], share[at]), [], None
                part = batch.slice(at, to - at)
                rows = arrow_matrix(part.column("v"), size)
                if not guest[at]:
                    queries.append((part.column("query"), rows))
                elif queries:
                    near = near or _Near(pa.concat_arrays([q for q, _ in queries]), np.concatenate([m for _, m in queries]), k, metric)
                    near.offer(rows, part.column("neighbour"), part.column("label"))
        if near:
            yield from near.nearest()

    return run
