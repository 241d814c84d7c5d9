"""An embedding index as an inverted file: entries by cell of a k-means model as partitioned Parquet, searched exactly for many queries at once.

A cell is the entries nearest to its centroid in angle; its radius is the largest of these angles. No entry of a cell is nearer to a query than
the query's angle to the centroid less the radius. So a query first visits the cells around it that hold k entries, and then those
whose bound its k-th best angle reaches; only the files of cells that some query visits are read. Zero vectors are a cell of their
own, at a right angle to all. The mean and deviation of a query's scores over all entries follow from the entries' first and second
moments, without a scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from statloom.functions.vectors import arrow_matrix, as_doubles, normalized
from statloom.models.kmeans import KMeans
from statloom.operators.cells import BLOCK, ROUNDING, SLACK, SLICE, TILE, angles, sample
from statloom.session import kept

#: Cells at most; rows for each cell that the model is fitted on; its iterations; rows of a file.
CELLS, ROWS, ITERATIONS, FILE = 1024, 64, 4, 1 << 17


@dataclass(frozen=True)
class InvertedFile:
    spark: SparkSession
    path: str
    centroids: np.ndarray  # unit vectors; the cell after the last holds the zero vectors
    radius: np.ndarray
    sizes: np.ndarray
    sums: np.ndarray  # of the unit vectors
    products: np.ndarray  # sums of the products of their components
    size: int  # components of a vector

    @classmethod
    def build(cls, entries: DataFrame, path: str, cells: int | None = None) -> InvertedFile:
        """Write entries (position, label, vector) under path. cells: about the square root of their number, if not given.

        Null vectors are left out; those of another length than most, or with elements that aren't finite, raise.
        """
        spark = entries.sparkSession
        rows = entries.where("vector is not null").select("position", "label", as_doubles("vector").alias("vector"), normalized("vector").alias("u"), F.col("position").alias("id"))
        found = rows.agg(F.count("*").alias("n"), F.min(F.size("u")).alias("low"), F.max(F.size("u")).alias("high"), F.bool_and(F.forall("u", lambda x: x.isNotNull() & ~F.isnan(x))).alias("fine")).first()
        if found["n"] and (found["low"] != found["high"] or not found["fine"]):
            raise ValueError("vectors must have one length and finite elements")
        size = found["high"] or 0
        cells = max(1, min(CELLS, cells or round(math.sqrt(found["n"]))))
        some = rows.where(F.exists("u", lambda x: x != 0)).select("id", "u")
        start = sample(some, size, cells) if size else np.zeros((0, 0))
        if len(start):
            model = KMeans.fit(some.orderBy(F.xxhash64("id"), "id").limit(ROWS * len(start)), "u", len(start), iterations=ITERATIONS, start=start.tolist())
            made = np.array(model.centroids)
            norm = np.linalg.norm(made, axis=1, keepdims=True)
            start = np.where(norm > 0, made / np.where(norm > 0, norm, 1), start)
        schema = StructType([*rows.drop("id").schema.fields, StructField("cell", IntegerType()), StructField("angle", DoubleType())])

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    u = arrow_matrix(batch.column("u"), size)
                    zero = ~u.any(axis=1)
                    far = angles(u, start) if len(start) else np.zeros((len(u), 1))
                    cell = np.where(zero, len(start), far.argmin(axis=1))
                    angle = np.where(zero, math.pi / 2, far.min(axis=1))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-2]), pa.array(cell, pa.int32()), pa.array(angle)], schema.names)

        files = max(1, round(found["n"] / cells / FILE))  # of a cell
        dealt = rows.mapInArrow(assign, schema).repartition("cell", F.pmod(F.xxhash64("position"), F.lit(files)))
        (dealt.write.partitionBy("cell") if found["n"] else dealt.write).parquet(f"{path}/entries")  # folders of nothing have no schema
        spark.createDataFrame([(k, c) for k, c in enumerate(start.tolist())], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> InvertedFile:
        """Reads the centroids, and sums over the entries that have the model's size."""
        held = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r["cell"])
        centroids = np.array([r["centroid"] for r in held], float) if held else np.zeros((0, 0))
        entries = cls._entries(spark, path)
        radius, sizes = np.full(len(held) + 1, -math.inf), np.zeros(len(held) + 1, np.int64)
        size = 0
        for r in entries.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"), F.max(F.size("u")).alias("size")).collect():
            radius[r["cell"]], sizes[r["cell"]], size = r["radius"], r["n"], r["size"]

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size + 1, size))
            for batch in batches:
                u = arrow_matrix(batch.column("u"), size)
                total[0] += u.sum(axis=0)
                total[1:] += u.T @ u
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["added"])

        total = np.zeros((size + 1) * size)
        if len(held):
            parts = entries.select("u").mapInArrow(moments, "added array<double>").select(F.posexplode("added").alias("j", "x"))
            for r in parts.groupBy("j").agg(F.sum("x").alias("x")).collect():
                total[r["j"]] = r["x"]
        total = total.reshape(size + 1, size)
        return cls(spark, path, centroids, radius, sizes, total[0], total[1:], size)

    @staticmethod
    def _entries(spark: SparkSession, path: str) -> DataFrame:
        return spark.read.parquet(f"{path}/entries").withColumn("cell", F.col("cell").cast("int"))

    def count(self) -> int:
        return int(self.sizes.sum())

    def _asked(self, queries: DataFrame, id: str, vector: str) -> DataFrame:
        return queries.select(F.col(id).alias("query"), normalized(vector).alias("q")).where(F.col("q").isNotNull() & (F.size("q") == self.size))

    def _visited(self, asked: DataFrame, k: int, reached: bool) -> DataFrame:
        """(query, q, cell): the cells nearest to a query that hold k entries; if reached, those of which its column ``angle`` reaches the
        bound, without the former. Queries of zeros visit every cell at first."""
        sizes, centroids, radius = self.sizes, self.centroids, self.radius
        schema = StructType([asked.schema["query"], asked.schema["q"], StructField("cell", IntegerType())])
        dim = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    q = arrow_matrix(part.column("q"), dim)
                    far, least = _bounds(q, centroids, radius)
                    far = np.where(sizes > 0, far, math.inf)
                    order = np.argsort(far, axis=1, kind="stable")
                    before = np.cumsum(sizes[order], axis=1) - sizes[order]
                    first = np.zeros(far.shape, bool)
                    np.put_along_axis(first, order, before < k, axis=1)
                    first |= ~q.any(axis=1)[:, None]
                    wanted = first & (sizes > 0)
                    if reached:
                        wanted = (least <= part.column("angle").to_numpy()[:, None]) & (sizes > 0) & ~first
                    i, cell = np.nonzero(wanted)
                    for s in range(0, len(i), SLICE):
                        rows = pa.array(i[s : s + SLICE])
                        yield pa.RecordBatch.from_arrays([part.column("query").take(rows), part.column("q").take(rows), pa.array(cell[s : s + SLICE], pa.int32())], schema.names)

        return asked.mapInArrow(run, schema)

    def _scored(self, visits: DataFrame, k: int) -> DataFrame:
        """(query, position, label, score): of each block of the cells visited, the k best entries of each query."""
        entries = self._entries(self.spark, self.path)
        blocks = -(-self.sizes // BLOCK)
        needed = [r["cell"] for r in visits.select("cell").distinct().collect()]  # CELLS + 1 at most
        spread = F.pmod(F.xxhash64("position"), F.greatest(F.lit(1), F.get(F.array(*map(F.lit, blocks.tolist())), F.col("cell"))))
        members = entries.where(F.col("cell").isin(*needed)).select("cell", spread.alias("block"), F.lit(False).alias("guest"), F.col("u").alias("v"), "position", "label", F.lit(None).cast(visits.schema["query"].dataType).alias("query"))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.get(F.array(*map(F.lit, np.maximum(blocks - 1, 0).tolist())), F.col("cell")).cast("long")))
        kinds = {f.name: f.dataType for f in entries.schema.fields}
        guests = visits.select("cell", every.alias("block"), F.lit(True).alias("guest"), F.col("q").alias("v"), F.lit(None).cast(kinds["position"]).alias("position"), F.lit(None).cast(kinds["label"]).alias("label"), "query")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        met = members.unionByName(guests).repartition(parts, "cell", "block").sortWithinPartitions("cell", "block", "guest")
        schema = StructType([visits.schema["query"], StructField("position", kinds["position"]), StructField("label", kinds["label"]), StructField("score", DoubleType())])
        return met.mapInArrow(_best(self.size, k), schema)

    def search(self, queries: DataFrame, id: str, vector: str, k: int) -> DataFrame:
        """(query, rank, position, label, score) of the k entries of the highest cosine; ties in ascending order of position.

        Queries that are null or of another length find nothing.
        """
        asked = kept(self._asked(queries, id, vector), "asked")
        if k < 1 or not self.count():
            kinds = self._entries(self.spark, self.path).schema if self.count() else None
            return asked.select("query", F.lit(0).cast("long").alias("rank"), F.lit(None).cast(kinds["position"].dataType if kinds else LongType()).alias("position"), F.lit(None).cast(kinds["label"].dataType if kinds else LongType()).alias("label"), F.lit(0.0).alias("score")).where(F.lit(False))
        near = kept(self._ranked(self._scored(self._visited(asked, k, False), k), k), "near")
        # a query's k-th best angle so far; a right angle and more if it has not met k entries
        last = near.groupBy("query").agg(F.when(F.max("rank") >= k, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.min("score"))))).otherwise(F.lit(math.pi)).alias("angle"))
        further = self._visited(asked.join(last, "query"), k, True)
        both = near.drop("rank").unionByName(self._scored(kept(further, "further"), k))
        return self._ranked(both, k).select("query", "rank", "position", "label", "score")

    @staticmethod
    def _ranked(scores: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "position"))
        return scores.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)

    def retrieve(self, queries: DataFrame, id: str, vector: str, k: int) -> DataFrame:
        """(query, hits, mean, deviation, top_score, top_z): the k best labels with their scores, mean and sample deviation of the scores of
        all entries, the best score, and how many deviations it is above the mean (null without spread). A row for each query that is understood."""
        n, sums, products = self.count(), self.sums, self.products
        asked = self._asked(queries, id, vector)
        schema = StructType([asked.schema["query"], StructField("mean", DoubleType()), StructField("deviation", DoubleType())])

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = arrow_matrix(batch.column("q"), len(sums))
                mean = q @ sums / max(n, 1)
                squares = ((q @ products) * q).sum(axis=1) - n * mean**2
                yield pa.RecordBatch.from_arrays([batch.column("query"), pa.array(mean), pa.array(np.sqrt(np.clip(squares, 0, None) / max(n - 1, 1)))], schema.names)

        found = self.search(queries, id, vector, k)
        hits = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "label", "score"))).alias("h"), F.max("score").alias("top_score"))
        made = asked.mapInArrow(spread, schema).join(hits, "query", "left")
        top = F.coalesce("top_score", F.lit(0.0))
        listed = F.transform("h", lambda h: F.struct(h["label"].alias("label"), h["score"].alias("score")))
        return made.select("query", listed.alias("hits"), "mean", "deviation", top.alias("top_score"), F.when(F.col("deviation") > 0, (top - F.col("mean")) / F.col("deviation")).alias("top_z"))


def _bounds(q: np.ndarray, centroids: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles of queries to the centroids, and the least that an entry of each cell can have; a right angle to zero vectors."""
    right = np.full((len(q), 1), math.pi / 2)
    far = np.concatenate([angles(q, centroids) if len(centroids) else np.zeros((len(q), 0)), right], axis=1)
    return far, np.concatenate([far[:, :-1] - radius[:-1], right], axis=1) - SLACK


def _best(size: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best of each block for each of its guests; rows come sorted by block, entries first."""

    def scored(guests: pa.RecordBatch, entries: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate([e[0] for e in entries])
        place, label = (pa.concat_arrays([e[j] for e in entries]) for j in (1, 2))
        places = np.argsort(pc.sort_indices(place).to_numpy())
        q = arrow_matrix(guests.column("v"), size)
        step = max(1, TILE // len(rows))
        for at in range(0, len(q), step):
            own = q[at : at + step]
            found = own @ rows.T
            least = np.partition(found, -k, axis=1)[:, -k] if k < len(rows) else np.full(len(own), -2.0)
            i, j = np.nonzero(found >= least[:, None] - ROUNDING)
            score = np.zeros(len(i))
            for c in range(size):  # component by component, so that equal vectors have equal scores in any block
                score += own[i, c] * rows[j, c]
            order = np.lexsort((places[j], -score, i))  # ties in order of position, so that k of a block are enough
            first = np.searchsorted(i[order], i[order])
            order = order[np.arange(len(order)) - first < k]
            i, j, score = i[order], j[order], score[order]
            yield pa.RecordBatch.from_arrays([guests.column("query").take(pa.array(i + at)), place.take(pa.array(j)), label.take(pa.array(j)), pa.array(score)], ["query", "position", "label", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, entries = None, []
        for batch in batches:
            cell, block, guest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "block", "guest"))
            cut = np.flatnonzero((np.diff(cell) != 0) | (np.diff(block) != 0) | (np.diff(guest.astype(int)) != 0)) + 1
            for at, to in zip([0, *cut.tolist()], [*cut.tolist(), len(cell)]):
                if to == at:
                    continue
                if key != (cell[at], block[at]):
                    key, entries = (cell[at], block[at]), []
                part = batch.slice(at, to - at)
                if not guest[at]:
                    entries.append((arrow_matrix(part.column("v"), size), part.column("position"), part.column("label")))
                elif entries:
                    yield from scored(part, entries)

    return run
