"""Exact order statistics of groups of any size, by selection: no group's values come together in one task.

Values are counted by group, and the counts of a group's distinct values are added up in order. If a group has more than BOUND rows, the
wanted ranks are narrowed first: two of GRID cut points, from a sketch of all groups at once, bracket each rank, one pass counts what lies
below, inside and above, and so on until each bracket has BOUND rows or one value. What is inside the brackets is counted exactly then. A
sketch is only a guess of where to cut: a rank that lies outside its bracket takes the part below or above it, so results don't depend on
the sketch's error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.core import double, finite, joined
from statloom.session import kept

#: Rows of a bracket whose distinct values one task puts in order; cut points of a round; accuracy of their sketch.
BOUND, GRID, ACCURACY = 1 << 18, 512, 4096


def _ranks(shares: Sequence[float], n: Column) -> Column:
    """The ranks (from 0) that the shares' percentiles lie between, as an array."""
    at = [(n - 1) * float(p) for p in shares]
    return F.array_distinct(F.array(*(f(h).cast("long") for h in at for f in (F.floor, F.ceil))))


def _in_order(counts: DataFrame, by: Sequence[str], below: Column | None = None) -> DataFrame:
    """Of (by, _v, _c), the counts of distinct values, each value with the ranks _from (included) and _to (excluded) that it has."""
    window = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("_c").over(window) + (below if below is not None else 0)
    return counts.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_c"))


def _inside(rows: DataFrame, boxes: DataFrame, by: Sequence[str], columns: Sequence[str] = ("_low", "_high")) -> DataFrame:
    """rows(by, _v) with each different box of their group (a struct of columns) that they lie in."""
    distinct = boxes.groupBy(*by).agg(F.collect_set(F.struct(*columns)).alias("_boxes"))
    in_box = F.filter("_boxes", lambda b: F.col("_v").between(b["_low"], b["_high"]))
    return joined(rows, distinct, by).select(*by, "_v", F.explode(in_box).alias("_box"))


def _narrowed(rows: DataFrame, by: Sequence[str], wanted: DataFrame) -> DataFrame:
    """(by, _v, _from, _to) of values that have a wanted rank, and of others, of rows(by, _v) and wanted(by, _n, _rank).

    Each rank has a box: _low and _high, both among the values, how many values are below it and how many (_m) in it.
    """
    ends = rows.groupBy(*by).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    boxes = kept(joined(wanted, ends, by).withColumn("_below", F.lit(0).cast("long")).withColumn("_m", F.col("_n")), "selection")
    is_wide = (F.col("_m") > BOUND) & (F.col("_low") < F.col("_high"))
    while not (wide := boxes.where(is_wide)).isEmpty():
        sketch = _inside(rows, wide, by).groupBy(*by, "_box").agg(F.percentile_approx("_v", [k / GRID for k in range(GRID + 1)], ACCURACY).alias("_cuts"))
        sketch = sketch.select(*by, F.col("_box._low").alias("_low"), F.col("_box._high").alias("_high"), "_cuts")
        place = (F.col("_rank") - F.col("_below")) / F.col("_m") * GRID
        cut = lambda k: F.get("_cuts", F.greatest(F.lit(0), F.least(F.lit(GRID), k)).cast("int"))
        guess = joined(wide, sketch, [*by, "_low", "_high"]).withColumn("_a", cut(F.floor(place - 0.5))).withColumn("_b", cut(F.ceil(place + 0.5)))
        # a guess that is the whole box, between two values that are many, gives way to the box's least value alone
        same = (F.col("_a") <= F.col("_low")) & (F.col("_b") >= F.col("_high"))
        guess = kept(guess.drop("_cuts").withColumn("_b", F.when(same, F.col("_a")).otherwise(F.col("_b"))), "selection")
        # what lies below, inside and above the guess, of the values in the box
        v, a, b = F.col("_v"), F.col("_box._a"), F.col("_box._b")
        counted = _inside(rows, guess, by, ("_low", "_high", "_a", "_b")).groupBy(*by, "_box").agg(
            F.count_if(v < a).alias("_under"), F.count_if(v.between(a, b)).alias("_within"), F.max(F.when(v < a, v)).alias("_last_under"), F.min(F.when(v > b, v)).alias("_first_over")
        )
        counted = counted.select(*by, "_box.*", "_under", "_within", "_last_under", "_first_over")
        met = joined(guess, counted, [*by, "_low", "_high", "_a", "_b"])
        own = F.col("_rank") - F.col("_below")
        low, high = own < F.col("_under"), own >= F.col("_under") + F.col("_within")
        pick = lambda under, within, over: F.when(low, F.col(under) if isinstance(under, str) else under).when(high, over).otherwise(within)
        upto = F.col("_under") + F.col("_within")
        met = met.select(
            *by, "_n", "_rank",
            pick("_low", F.col("_a"), F.col("_first_over")).alias("_low"),
            pick("_last_under", F.col("_b"), F.col("_high")).alias("_high"),
            (F.col("_below") + pick(F.lit(0), F.col("_under"), upto)).alias("_below"),
            pick("_under", F.col("_within"), F.col("_m") - upto).alias("_m"),
        )
        boxes = kept(boxes.where(~is_wide).unionByName(met), "selection")
    counts = _inside(rows, boxes, by, ("_low", "_high", "_below")).groupBy(*by, "_box", "_v").agg(F.count("*").alias("_c"))
    return _in_order(counts, [*by, "_box"], F.col("_box._below")).select(*by, "_v", "_from", "_to")


def order_statistics(df: DataFrame, x: str | Column, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, n, fine, values): of each group the number of values that aren't null, whether all are finite, and for each share (0 to 1) the
    percentile of type 7, in an array; nulls where a value isn't finite. Groups without values have no row, a table without by always one."""
    rows = df.select(*by, double(x).alias("_v")).where("_v is not null")
    most = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    if most <= BOUND:
        counts = rows.groupBy(*by, "_v").agg(F.count("*").alias("_c"))
        n = F.sum("_c").over(Window.partitionBy(*by))
        placed = _in_order(counts, by).withColumn("_n", n).withColumn("_fine", finite("_v"))
        return _read(placed, by, shares)
    sizes = kept(rows.groupBy(*by).agg(F.count("*").alias("_n"), F.bool_and(finite("_v")).alias("_fine")), "selection")
    wanted = sizes.where("_fine").select(*by, "_n", F.explode(_ranks(shares, F.col("_n"))).alias("_rank"))
    placed = joined(sizes, _narrowed(rows.where(finite("_v")), by, wanted), by, "left")
    return _read(placed, by, shares)


def _read(placed: DataFrame, by: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """The percentiles from (by, _n, _fine, _v, _from, _to), which has the values of all wanted ranks."""
    values = []
    for p in shares:
        h = (F.col("_n") - 1) * float(p)
        at = lambda rank: F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_v")))
        low, high, part = at(F.floor(h)), at(F.ceil(h)), F.max(h - F.floor(h))
        values.append(F.when(part == 0, low).otherwise(low + part * (high - low)))
    fine = F.bool_and("_fine")
    every = F.array(*(F.when(fine, v) for v in values))
    return placed.groupBy(*by).agg(F.coalesce(F.max("_n"), F.lit(0)).cast("long").alias("n"), F.coalesce(fine, F.lit(True)).alias("fine"), every.alias("values"))
