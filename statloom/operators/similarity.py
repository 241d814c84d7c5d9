"""Cosine similarity, top-k retrieval, near duplicates, cohesion and an embedding index over vector columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.vectors import as_doubles, dot, literal, magnitude, normalized
from statloom.operators.aggregates import mean_vector
from statloom.operators.cells import similar_pairs


def cosine_to(v: str, target: list[float]) -> Column:
    """Cosine of each vector and one target; 0 if either is zero. The target's norm is computed once, on the driver."""
    norm = math.sqrt(sum(x * x for x in target))
    if not norm:
        return F.lit(0.0)
    n = magnitude(v)
    return F.when(n > 0, F.try_divide(dot(v, literal([x / norm for x in target])), n)).otherwise(F.lit(0.0))


def cosine_similarities(df: DataFrame, v: str, target: list[float], name: str = "similarity") -> DataFrame:
    return df.withColumn(name, cosine_to(v, target))


def most_similar(df: DataFrame, v: str, label: str, target: list[float], k: int = 5) -> DataFrame:
    """(rank, label, score) of the k nearest vectors of the target's length; ties in ascending order of label."""
    best = df.where(F.size(v) == len(target)).select(label, cosine_to(v, target).alias("score")).orderBy(F.desc("score"), label).limit(max(0, k))
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), label)).cast("long").alias("rank"), label, "score")


nearest = most_similar


def find_duplicates(df: DataFrame, v: str, id: str, threshold: float = 0.95) -> DataFrame:
    """(id1, id2, similarity) with id1 < id2 and cosine >= threshold; zero vectors have no duplicates. Vectors of different lengths raise.

    Exact: vectors meet in the cells that can hold partners, and are multiplied in full where a bound reaches the threshold (``cells``).
    """
    return similar_pairs(df, v, id, threshold)


def cluster_cohesion(df: DataFrame, v: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean cosine of all pairs of non-zero vectors, 0 under two: (|sum of unit vectors|^2 - m) / (m (m - 1)), without a pair being formed."""
    units = df.select(*by, normalized(v).alias("_u")).where(F.exists("_u", lambda x: x != 0))
    parts = units.select(*by, F.posexplode("_u").alias("_k", "_x")).groupBy(*by, "_k").agg(F.sum("_x").alias("_s"), F.count("*").alias("_m"))
    made = parts.groupBy(*by).agg(F.sum(F.col("_s") * F.col("_s")).alias("_q"), F.max("_m").alias("_m"))
    m = F.col("_m")
    return made.select(*by, F.when(m > 1, (F.col("_q") - m) / (m * (m - 1))).otherwise(F.lit(0.0)).alias("cohesion"))


def averaged(df: DataFrame, v: str, by: tuple[str, ...] = (), name: str = "mean") -> DataFrame:
    """Element-wise mean of vectors as a vector; no row for groups whose vectors differ in length."""
    return mean_vector(df, v, by).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "mean"))), lambda s: s["mean"]).alias(name))


def valid_dimensions(df: DataFrame, v: str) -> DataFrame:
    """``valid``: whether all vectors have one length."""
    return df.agg(F.coalesce(F.min(F.size(v)) == F.max(F.size(v)), F.lit(True)).alias("valid"))


class EmbeddingIndex:
    """Entries (position, label, vector) and an embedder, a function from text column to vector column (null: not understood).

    The index is a value: every change gives a new one over a new plan. ``save`` and ``load`` keep the entries as Parquet.
    """

    def __init__(self, entries: DataFrame, embedder: Callable[[Column], Column]):
        self.entries = entries.select("position", "label", as_doubles("vector").alias("vector"))
        self.embedder = embedder

    def add(self, texts: DataFrame) -> EmbeddingIndex:
        """With texts (position, text, label); those that the embedder refuses are skipped."""
        more = texts.select("position", "label", self.embedder(F.col("text")).alias("vector")).where("vector is not null")
        return EmbeddingIndex(self.entries.unionByName(more.select("position", "label", as_doubles("vector").alias("vector"))), self.embedder)

    def add_vectors(self, vectors: DataFrame) -> EmbeddingIndex:
        return EmbeddingIndex(self.entries.unionByName(vectors.select("position", "label", as_doubles("vector").alias("vector"))), self.embedder)

    def remove(self, *labels) -> EmbeddingIndex:
        return EmbeddingIndex(self.entries.where(~F.col("label").isin(*labels)) if labels else self.entries, self.embedder)

    def remove_all(self, labels: DataFrame | None = None) -> EmbeddingIndex:
        """Without the labels of a table, or without any entry."""
        return EmbeddingIndex(self.entries.where(F.lit(False)) if labels is None else self.entries.join(labels.select("label"), "label", "left_anti"), self.embedder)

    def count(self) -> int:
        return self.entries.count()

    def is_empty(self) -> bool:
        return self.entries.isEmpty()

    def vectors(self) -> DataFrame:
        return self.entries.orderBy("position").select("vector")

    def vector(self, label) -> list[float] | None:
        """The vector of the first entry with the label."""
        row = self.entries.where(F.col("label") == label).orderBy("position").first()
        return row and row["vector"]

    def scores(self, query: list[float]) -> DataFrame:
        return self.entries.select("position", "label", cosine_to("vector", query).alias("score"))

    def labels(self) -> DataFrame:
        return self.entries.orderBy("position").select("label")

    def contains(self, label) -> bool:
        return not self.entries.where(F.col("label") == label).isEmpty()

    def __iter__(self):
        """(label, vector) of the entries in order, streamed to the driver a partition at a time."""
        for row in self.entries.orderBy("position").toLocalIterator():
            yield row["label"], row["vector"]

    def embedded(self, text: str) -> list[float] | None:
        """The embedder's vector of a text, None if it refuses it."""
        row = self.entries.sparkSession.createDataFrame([(text,)], "text string").select(as_doubles(self.embedder(F.col("text"))).alias("v")).first()
        return row["v"]

    def retrieve(self, query: list[float] | str, k: int) -> DataFrame:
        """One row: hits (the k best labels with their scores), mean and sample deviation of all scores, top_score and top_z.

        query: a vector, or a text for the embedder; one that it refuses finds nothing.
        """
        if isinstance(query, str):
            vector = self.embedded(query)
            return retrieve(self.scores(vector) if vector is not None else self.scores([]).where(F.lit(False)), k)
        return retrieve(self.scores(query), k)

    def save(self, path: str) -> None:
        self.entries.write.parquet(path)

    @classmethod
    def load(cls, spark, path: str, embedder: Callable[[Column], Column]) -> EmbeddingIndex:
        return cls(spark.read.parquet(path), embedder)


def retrieve(scores: DataFrame, k: int) -> DataFrame:
    """Of (position, label, score): hits, mean, deviation, top_score and top_z (null without spread); zeros of nothing."""
    stats = scores.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("deviation"), F.coalesce(F.max("score"), F.lit(0.0)).alias("top_score"))
    best = scores.orderBy(F.desc("score"), "position").limit(k)
    hits = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "position", "label", "score"))).alias("h"))
    hits = hits.select(F.transform("h", lambda h: F.struct(h["label"].alias("label"), h["score"].alias("score"))).alias("hits"))
    z = F.when(F.col("deviation") > 0, (F.col("top_score") - F.col("mean")) / F.col("deviation"))
    return stats.crossJoin(F.broadcast(hits)).select("hits", "mean", "deviation", "top_score", z.alias("top_z"))


def above_gate(result: DataFrame, floor: float, outlier_z: float) -> DataFrame:
    """``above``: the best score reaches floor, or its z reaches outlier_z (an undefined z is 0)."""
    return result.withColumn("above", (F.col("top_score") >= floor) | (F.coalesce("top_z", F.lit(0.0)) >= outlier_z))

