"""What the pipeline operators share: reading tables, cutting lineage, and Arrow helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.session import ship

#: Bytes of text that one numpy pass works on; longer texts come alone.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master (tests) gets one of its
    own, and a cluster an error, as its machines don't share temporary folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="statloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written once to the shared folder and read from there: later reads don't compute it again and survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/statloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it no column of df (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hashed_below(share: Column, *key: Column) -> Column:
    """Whether a hash of key, uniform in 0 to 1, is below share; its 62 bits are fine enough for any number of rows."""
    return F.shiftrightunsigned(F.xxhash64(*key), 2) < (share * float(1 << 62))


#: Rows of a group that one task takes in a join, and how many groups may be larger: as these are broadcast, a bound of their number.
HOT, HOT_GROUPS = 1024, 100_000


def spread_join(rows: DataFrame, groups: DataFrame, key: str, size: str, own: Column, total: int, most: int | None = None) -> DataFrame:
    """rows joined with groups (one for each key, size of its rows) on key, without meeting of all rows of a large group in one task.

    The groups of more than HOT rows, and of more than a HOT_GROUPSth of total, which is at least the sum of sizes, are broadcast:
    HOT_GROUPS rows at most. Their rows are dealt by ``own``, which differs from row to row and has the type of key. If most, which
    no size exceeds, says that there are none, it is a plain join.
    """
    others = [c for c in groups.columns if c != key]
    least = max(HOT, total // HOT_GROUPS)
    if most is not None and most <= least:
        return rows.join(groups, key).select(*rows.columns, *others)
    hot = groups.where(F.col(size) > least).select(F.col(key).alias("_hot_key"), F.struct(*others).alias("_hot"))
    cold = groups.where(F.col(size) <= least).select(F.col(key).alias("_cold_key"), F.struct(*others).alias("_cold"))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    dealt = dealt.withColumn("_at", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(own))
    found = dealt.join(cold, F.col("_at") == F.col("_cold_key"), "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return found.where(F.col("_found").isNotNull()).select(*rows.columns, *(F.col("_found")[c].alias(c) for c in others))


def packed(values: np.ndarray) -> bytes:
    """The numbers of an example on its way to a fit on the driver, compressed."""
    return zlib.compress(values.tobytes(), 1)


def unpacked(raw: pa.Scalar, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw.as_buffer()), kind)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit("text"))


def repeats(batch: pa.RecordBatch, by: list[np.ndarray], column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The rows of batch to keep, one of those alike in all arrays of ``by`` and in the text, and how many each stands for."""
    n = batch.num_rows
    times = np.ones(n, np.int64)
    order = np.lexsort(by)
    alike = np.ones(max(0, n - 1), bool)
    for x in by:
        alike &= x[order[1:]] == x[order[:-1]]
    if alike.any():
        texts = batch.column(column)
        first = order[0] if n else 0
        for k in np.flatnonzero(alike):
            if k == 0 or not alike[k - 1]:
                first = order[k]
            if texts[int(order[k + 1])].equals(texts[int(first)]):
                times[first] += 1
                times[order[k + 1]] = 0
    kept = np.flatnonzero(times)
    return kept, times[kept]


def text_parts(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of batch with at most SLICE_BYTES of text, or one row."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + SLICE_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty texts, and where each row starts (one more for the end)."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]], 0 for empty segments."""
    n = len(offsets) - 1
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out
