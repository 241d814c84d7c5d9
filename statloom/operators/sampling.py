"""Sampling, splits and resampling by keyed hashes: the same seed gives the same rows in any engine and partitioning.

Rows are shuffled by the md5 of "seed:id", ties by id. Sizes are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.core import BLOCK, with_position, with_stats


def shuffle_key(seed: int, *ids: Column | str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *((F.col(c) if isinstance(c, str) else c).cast("string") for c in ids)))


def hash_unit(seed: int, *ids: Column | str) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of the key."""
    return F.conv(F.substring(shuffle_key(seed, *ids), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def shuffled(df: DataFrame, id: str, seed: int, name: str = "order") -> DataFrame:
    """df with each row's 0-based place in the shuffle, counted within ranges of the key and over these."""
    keyed = df.withColumn("_key", shuffle_key(seed, id)).withColumn("_range", F.conv(F.substring("_key", 1, 3), 16, 10).cast("int"))
    sizes = keyed.groupBy("_range").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows
    sizes = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_key", id)) - 1
    return keyed.withColumn("_inside", inside).join(F.broadcast(sizes), "_range").withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_key", "_range", "_before", "_inside")


def sample(df: DataFrame, id: str, count: int, seed: int, replace: bool = True) -> DataFrame:
    """count rows (with ``draw``): drawn with replacement, or the first of the shuffle, of which count may be at most all."""
    if not replace:
        return df.withColumn("_key", shuffle_key(seed, id)).orderBy("_key", id).limit(count).drop("_key")
    n = df.count()
    draws = df.sparkSession.range(count).select(F.col("id").alias("draw"), F.floor(hash_unit(seed, F.col("id")) * n).cast("long").alias("_at"))
    return draws.join(with_position(df, id, "_at"), "_at").drop("_at")


def _check_ratio(ratio: float) -> None:
    if not 0 < ratio < 1:
        raise ValueError("the test ratio must be between 0 and 1")


def train_test_split(df: DataFrame, id: str, test_ratio: float, seed: int) -> DataFrame:
    """df with ``is_test``: the first ceil(n * test_ratio) rows of the shuffle."""
    _check_ratio(test_ratio)
    made = with_stats(shuffled(df, id, seed, "_order"), _n=F.count(F.lit(1)))
    return made.withColumn("is_test", F.col("_order") < F.ceil(F.col("_n") * F.lit(test_ratio))).drop("_order", "_n")


def k_folds(df: DataFrame, id: str, k: int, seed: int) -> DataFrame:
    """df with ``fold``: the one fold of k in which a row is validated; sizes differ by one at most, the first folds being larger."""
    n = df.count()
    if not 2 <= k <= n:
        raise ValueError("k must be between 2 and the number of rows")
    size, more = divmod(n, k)
    order = F.col("_order")
    fold = F.when(order < more * (size + 1), F.floor(order / (size + 1))).otherwise(F.lit(more) + F.floor((order - more * (size + 1)) / size))
    return shuffled(df, id, seed, "_order").withColumn("fold", fold.cast("long")).drop("_order")


def stratified_split(df: DataFrame, id: str, label: str, test_ratio: float, seed: int) -> DataFrame:
    """df with ``is_test``: of each class of c rows, min(max(1, ceil(c * ratio)), c - 1) of the shuffle; a single row trains.

    A class's rows are ranked within ranges of the key, so a large class is spread over tasks.
    """
    _check_ratio(test_ratio)
    keyed = df.withColumn("_key", shuffle_key(seed, id)).withColumn("_range", F.substring("_key", 1, 2))
    sizes = keyed.groupBy(label, "_range").agg(F.count("*").alias("_size"))
    by = Window.partitionBy(label)
    sizes = sizes.select(label, "_range", F.coalesce(F.sum("_size").over(by.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_size").over(by).alias("_c"))
    inside = F.row_number().over(Window.partitionBy(label, "_range").orderBy("_key", id)) - 1
    made = keyed.withColumn("_inside", inside).join(sizes, [label, "_range"])
    test = F.when(F.col("_c") > 1, F.least(F.greatest(F.lit(1), F.ceil(F.col("_c") * F.lit(test_ratio))), F.col("_c") - 1)).otherwise(F.lit(0))
    return made.withColumn("is_test", F.col("_before") + F.col("_inside") < test).drop("_key", "_range", "_inside", "_before", "_c")


def class_position(df: DataFrame, id: str, label: str, name: str) -> DataFrame:
    """df with each row's 0-based place in its class, in the order of a numeric id without ties: counted in ranges of the id, and over these."""
    placed = with_position(df, id, "_at").withColumn("_block", F.floor(F.col("_at") / BLOCK))
    by = Window.partitionBy(label).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    before = placed.groupBy(label, "_block").agg(F.count("*").alias("_n")).select(label, "_block", F.coalesce(F.sum("_n").over(by), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(label, "_block").orderBy("_at")) - 1
    made = placed.withColumn("_inside", inside).join(before, [label, "_block"])
    return made.withColumn(name, F.col("_before") + F.col("_inside")).drop("_at", "_block", "_inside", "_before")


def oversample(df: DataFrame, id: str, label: str, features: str, seed: int) -> DataFrame:
    """Rows (label, features, synthetic): all rows, and for each lesser class points between consecutive rows (in the order of id, the
    last followed by the first), until every class has as many as the largest. Where a point lies follows from the seed."""
    ordered = class_position(df.select(id, label, features).where(F.col(label).isNotNull()), id, label, "_i").select(label, features, "_i")
    sizes = df.groupBy(label).agg(F.count("*").alias("_m"))
    sizes = with_stats(sizes, _most=F.max("_m"))
    # numbers of the missing rows: blocks of them are dealt to tasks, and counted out there
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_most") - F.col("_m") - 1) / BLOCK))
    dealt = sizes.where("_m < _most").select(label, "_m", "_most", F.explode(blocks).alias("_block")).repartition(label, "_block")
    last = F.least(F.col("_most") - F.col("_m"), (F.col("_block") + 1) * BLOCK) - 1
    wanted = dealt.select(label, "_m", F.explode(F.sequence(F.col("_block") * BLOCK, last)).alias("_k"))
    wanted = wanted.select(label, "_k", F.pmod("_k", "_m").alias("_i"), F.pmod(F.col("_k") + 1, F.col("_m")).alias("_j"))
    first = ordered.withColumnRenamed(features, "_a")
    second = ordered.select(label, F.col(features).alias("_b"), F.col("_i").alias("_j"))
    t = hash_unit(seed, label, "_k")
    between = F.zip_with("_a", "_b", lambda a, b: a + (b - a) * t)
    made = wanted.join(first, [label, "_i"]).join(second, [label, "_j"]).select(label, between.alias(features), F.lit(True).alias("synthetic"))
    return df.select(label, features, F.lit(False).alias("synthetic")).unionByName(made)


def sampling_distribution(df: DataFrame, id: str, x: str, statistic: Callable[[Column], Column], sample_size: int | None = None, iterations: int = 1000, seed: int = 0) -> DataFrame:
    """(iteration, value): statistic, an aggregate of a column, of samples with replacement (of n rows each if sample_size is None)."""
    if iterations < 1 or sample_size is not None and sample_size < 1:
        raise ValueError("iterations and sample_size must be positive")
    n = df.where(F.col(x).isNotNull()).count()
    size = n if sample_size is None else sample_size
    values = with_position(df.where(F.col(x).isNotNull()).select(id, F.col(x).cast("double").alias("_x")), id, "_at").select("_at", "_x")
    grid = df.sparkSession.range(iterations * size).select(F.floor(F.col("id") / size).cast("long").alias("iteration"), F.pmod(F.col("id"), F.lit(size)).alias("_k"))
    draws = grid.select("iteration", F.floor(hash_unit(seed, "iteration", "_k") * n).cast("long").alias("_at"))
    return draws.join(values, "_at").groupBy("iteration").agg(statistic(F.col("_x")).alias("value"))


def resampled(df: DataFrame, id: str, x: str, statistic: Callable[[Column], Column], iterations: int = 1000, seed: int = 0) -> DataFrame:
    """The bootstrap distribution of a statistic."""
    return sampling_distribution(df, id, x, statistic, None, iterations, seed)


#: Statistics with names of their own.
STATISTICS: dict[str, Callable[[Column], Column]] = {"mean": F.avg, "median": lambda x: F.percentile(x, 0.5), "standard_deviation": F.stddev_samp}


def sampling_distribution_of(name: str, df: DataFrame, id: str, x: str, sample_size: int, iterations: int = 1000, seed: int = 0) -> DataFrame:
    return sampling_distribution(df, id, x, STATISTICS[name], sample_size, iterations, seed)


