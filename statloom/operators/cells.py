"""Unit vectors in cells around pivots: which cells can hold partners of a vector, by the triangle inequality of angles.

A cell is what is nearest to its pivot, and its radius the largest angle to it. Vectors that are within an angle a of each other have angles to
any pivot that differ by a at most. So a vector has partners in a cell only if its angle to that pivot exceeds neither the cell's radius nor
its angle to its own pivot by more than a and 2 a. Pivots are a bounded number of rows, which decide how much is compared and not what is found.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from statloom.functions.vectors import arrow_matrix, normalized
from statloom.session import kept

#: Rows of a block of a cell, which a task holds as a matrix; rows that one pass looks at; pivots at most; rows that choose the rotation; slack
#: for rounding of angles and products.
BLOCK, SLICE, PIVOTS, SAMPLE, SLACK, ROUNDING = 8192, 2048, 1024, 1024, 1e-6, 1e-9
#: Products of one pass.
TILE = 1 << 22


def angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1, 1))


def sample(units: DataFrame, size: int, count: int) -> np.ndarray:
    """``count`` of the vectors u of units(id, u), those of the least hashes of their ids, as a matrix."""
    rows = units.orderBy(F.xxhash64("id"), "id").select("u").limit(count).toArrow()["u"].combine_chunks()
    return arrow_matrix(rows, size)


def placed(units: DataFrame, pivots: np.ndarray) -> DataFrame:
    """units(id, u) with ``cell``, the nearest pivot, and ``angle`` to it."""
    size = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = angles(arrow_matrix(batch.column("u"), size), pivots)
                cell = found.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(found[np.arange(len(cell)), cell])], [*batch.schema.names, "cell", "angle"])

    return units.mapInArrow(run, StructType([*units.schema.fields, *units.sparkSession.createDataFrame([], "cell int, angle double").schema.fields]))


def head(rows: np.ndarray, threshold: float) -> np.ndarray:
    """Orthonormal columns, the fewest that pay: what rows have in common with them, and how much is left of either, bounds their products.

    The columns lie along the largest squares of the rows, few of which leave little.
    """
    _, axes = np.linalg.eigh(rows.T @ rows)
    axes = axes[:, ::-1]
    turned = rows[:256] @ axes
    upper = np.triu_indices(len(turned), 1)
    best, cost = axes.shape[1], math.inf
    for h in range(min(4, axes.shape[1]), axes.shape[1] + 1, 4):
        left = np.sqrt(np.clip(1 - np.square(turned[:, :h]).sum(axis=1), 0, 1))
        share = np.mean((turned[:, :h] @ turned[:, :h].T + np.outer(left, left))[upper] >= threshold - ROUNDING) if len(upper[0]) else 0.0
        if h + 8 * share * axes.shape[1] < cost:
            best, cost = h, h + 8 * share * axes.shape[1]
    return np.ascontiguousarray(axes[:, :best])


def bounded(rows: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Rows whose products bound those of the whole rows: their parts along the axes, and the length of the rest."""
    along = rows @ axes
    return np.column_stack([along, np.sqrt(np.clip(1 - np.square(along).sum(axis=1), 0, None))])


def _visits(pivots: np.ndarray, radius: np.ndarray, blocks: np.ndarray, reach: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row once as a member of its cell's block, and as a guest of the blocks before it and of those of earlier cells that may hold partners."""
    size = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                cell, angle, own = (part.column(c).to_numpy() for c in ("cell", "angle", "hash"))
                own = own % blocks[cell]
                found = angles(arrow_matrix(part.column("u"), size), pivots)
                near = (found <= radius + reach + SLACK) & (found <= angle[:, None] + 2 * reach + SLACK) & (np.arange(len(pivots)) < cell[:, None])
                i, j = np.nonzero(near)
                rows = np.concatenate([np.arange(len(cell)), np.repeat(np.arange(len(cell)), own), np.repeat(i, blocks[j])])
                cells = np.concatenate([cell, np.repeat(cell, own), np.repeat(j, blocks[j])])
                count = np.concatenate([own, blocks[j]])
                before = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                block = np.concatenate([own, before])
                guest = np.arange(len(rows)) >= len(cell)
                for k in range(0, len(rows), SLICE):
                    s = slice(k, k + SLICE)
                    taken = pa.array(rows[s])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(taken), part.column("u").take(taken), pa.array(cells[s], pa.int32()), pa.array(block[s], pa.int64()), pa.array(guest[s])], ["id", "u", "cell", "block", "guest"]
                    )

    return run


def _compared(axes: np.ndarray, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of members, and of members and guests, of each block, which come sorted by block, members first."""
    size = axes.shape[0]

    def pairs(a: tuple, b: tuple, alike: bool) -> Iterator[pa.RecordBatch]:
        step = max(1, TILE // len(b[1]))
        for at in range(0, len(a[1]), step):
            i, j = np.nonzero(a[2][at : at + step] @ b[2].T >= threshold - ROUNDING)
            i += at
            if alike:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 18):
                x, y = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
                similarity = np.zeros(len(x))
                for c in range(size):  # added up component by component, as the column function does
                    similarity += a[1][x, c] * b[1][y, c]
                kept = similarity >= threshold
                left, right = a[0].take(pa.array(x[kept])), b[0].take(pa.array(y[kept]))
                turned, differ = pc.less(right, left), pc.not_equal(left, right)
                found = pa.RecordBatch.from_arrays([pc.if_else(turned, right, left), pc.if_else(turned, left, right), pa.array(similarity[kept])], ["id1", "id2", "similarity"])
                yield found.filter(differ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []
        for batch in batches:
            cell, block, guest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "block", "guest"))
            cut = np.flatnonzero((np.diff(cell) != 0) | (np.diff(block) != 0) | (np.diff(guest.astype(int)) != 0)) + 1
            for at, to in zip([0, *cut.tolist()], [*cut.tolist(), len(cell)]):
                if to == at:
                    continue
                if key != (cell[at], block[at]):
                    key, members = (cell[at], block[at]), []
                rows = arrow_matrix(batch.column("u").slice(at, to - at), size)
                own = (batch.column("id").slice(at, to - at), rows, bounded(rows, axes))
                for other in members:
                    yield from pairs(own, other, False)
                if not guest[at]:
                    yield from pairs(own, own, True)
                    members.append(own)

    return run


def similar_pairs(df: DataFrame, v: str, id: str, threshold: float) -> DataFrame:
    """(id1, id2, similarity) with id1 < id2 and cosine >= threshold of all vectors but zeros and those with elements that aren't finite.

    Exact. Vectors meet in the blocks of cells that can hold partners; what is multiplied in full are pairs whose bound reaches the threshold.
    """
    found = df.select(F.col(id).alias("id"), normalized(v).alias("u"), F.pmod(F.xxhash64(id), F.lit(1 << 40)).alias("hash"))
    found = found.where(F.exists("u", lambda x: x != 0) & F.forall("u", lambda x: x.isNotNull() & ~F.isnan(x)))
    kind = found.schema["id"].dataType
    schema = StructType([StructField("id1", kind), StructField("id2", kind), StructField("similarity", DoubleType())])
    shape = found.agg(F.count("*").alias("n"), F.min(F.size("u")).alias("low"), F.max(F.size("u")).alias("high")).first()
    if not shape["n"]:
        return df.sparkSession.createDataFrame([], schema)
    if shape["low"] != shape["high"]:
        raise ValueError("vectors differ in length")
    rows = sample(found.select("id", "u"), shape["high"], SAMPLE)
    pivots = rows[: max(1, min(PIVOTS, shape["n"] // BLOCK))]
    table = kept(placed(found, pivots), "cells")
    sizes = table.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()  # a row a pivot
    radius, blocks = np.full(len(pivots), -math.inf), np.zeros(len(pivots), np.int64)
    for r in sizes:
        radius[r["cell"]], blocks[r["cell"]] = r["radius"], -(-r["n"] // BLOCK)
    reach = math.acos(max(-1.0, min(1.0, threshold)))
    met = table.mapInArrow(_visits(pivots, radius, blocks, reach), StructType([found.schema["id"], found.schema["u"], *df.sparkSession.createDataFrame([], "cell int, block long, guest boolean").schema.fields]))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(blocks.sum()), 4096))
    ordered = met.repartition(parts, "cell", "block").sortWithinPartitions("cell", "block", "guest")
    return ordered.mapInArrow(_compared(head(rows, threshold), threshold), schema)
