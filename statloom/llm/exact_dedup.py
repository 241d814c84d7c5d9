"""Exact duplicates by progressive refinement: length, then a hash of the text's beginning, then a hash of all of it.

Texts are equal if they are identical after lower-casing A to Z, and nothing else. Each refinement reads the documents once and looks
further only at those whose key so far was met twice: lengths in bytes are counted, then (length, first PREFIX characters) of texts whose
length was met twice, then SHA-256 of texts whose beginning was met twice. Only rows that come so far are shuffled, by their
hash, with the columns asked for.

What was met twice is a bitmap of FILTER_BITS bits, 16 MB at most for any input, that goes to every task. Two keys may share a bit: then a
text is read further than it need be, and the next hash tells. The last step is exact, so the result depends on no filter.

Of equal texts the row with the largest id stays; null ids come before all others, and of rows alike in id and text any one stays. Null
texts are empty texts, which are equal to each other. Texts are hashed whole, however long. Empty tables give no rows. A
group may hold nearly all rows: groups are reduced before they are shuffled, and joined to the rows without meeting in one task.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.shared import spread_join, stored, unused

#: Characters of a text's beginning; bits of a filter (a power of two, 32,768 or more), in maps of 32,768, as Spark's bitmaps are.
PREFIX, FILTER_BITS, MAP_BITS = 256, 1 << 27, 1 << 15
#: The columns that ``mark`` adds.
MARKS = ("keep_id", "group_size", "kept")


def normalised(text: Column) -> Column:
    """text with A to Z in lower case; null is empty. Texts of ASCII alone take the shorter way."""
    known = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(known) == F.length(known), F.lower(known)).otherwise(F.translate(known, string.ascii_uppercase, string.ascii_lowercase))


def _met_twice(keys: DataFrame) -> DataFrame:
    """A filter (_map, _bits) of what is more than once in the column of whole numbers ``_key``."""
    twice = keys.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    bit = F.pmod("_key", F.lit(FILTER_BITS))
    return twice.groupBy(F.floor(bit / MAP_BITS).cast("int").alias("_map")).agg(F.bitmap_construct_agg(bit % MAP_BITS).alias("_bits"))


def _may_be_in(rows: DataFrame, key: Column, found: DataFrame, name: str) -> DataFrame:
    """rows with ``name``, whether the filter has key: true for all it was made of, and for few others. Maps are at most FILTER_BITS / MAP_BITS rows."""
    bit = F.pmod(key, F.lit(FILTER_BITS))
    joined = rows.withColumn("_bit", bit).join(F.broadcast(found), F.floor(F.col("_bit") / MAP_BITS).cast("int") == F.col("_map"), "left")
    byte = F.conv(F.hex(F.substring("_bits", ((F.col("_bit") % MAP_BITS) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("shiftright(_byte, cast(_bit % 8 as int)) & 1") == 1
    return joined.withColumn("_byte", byte).withColumn(name, F.coalesce(is_set, F.lit(False))).drop("_bit", "_map", "_bits", "_byte")


def mark(docs: DataFrame, id: str = "doc_id", text: str = "text", carry: Sequence[str] = (), digest: str | None = None) -> DataFrame:
    """A row for each row of docs: its id, the columns to carry, keep_id (the id of the row that stays), group_size and kept.

    digest: a name for the lower-case hexadecimal SHA-256 of every normalised text, where the caller wants them; else only texts that may
    have an equal are hashed. Columns to carry that are named like those added give way to them.
    """
    taken = {c.lower() for c in (id, *MARKS, *((digest,) if digest else ()))}
    carry = [c for c in carry if c.lower() not in taken]
    own = unused(docs, "_text")
    rows = docs.select(id, *carry, F.coalesce(F.col(text), F.lit("")).alias(own))
    length = F.octet_length(own).cast("long")
    beginning = F.xxhash64(length, normalised(F.substring(own, 1, PREFIX)))

    lengths = _met_twice(rows.select(length.alias("_key")))
    may = _may_be_in(rows.select(own), length, lengths, "_may").where("_may")
    beginnings = _met_twice(may.select(beginning.alias("_key")))
    # a length that was met once has no beginning there, but for those that share a bit
    hashed = F.sha2(normalised(F.col(own)), 256)
    reached = _may_be_in(rows, beginning, beginnings, "_may").withColumn("_hash", hashed if digest else F.when(F.col("_may"), hashed))
    reached = stored(reached.select(id, *carry, "_may", F.unhex("_hash").alias("_hash"), F.monotonically_increasing_id().alias("_row")), "exact-dedup")

    shown = (F.lower(F.hex("_hash")).alias(digest),) if digest else ()
    alone = reached.where(~F.col("_may")).select(id, *carry, F.col(id).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *shown)
    met = reached.where("_may")
    last = F.max(F.struct(F.col(id).alias("id"), F.col("_row").alias("row"))).alias("_last")
    groups = stored(met.groupBy("_hash").agg(last, F.count("*").alias("group_size")), "exact-dedup-groups")
    sizes = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("total"), F.coalesce(F.max("group_size"), F.lit(0)).alias("most")).first()
    joined = spread_join(met, groups, "_hash", "group_size", F.unhex(F.hex("_row")), sizes["total"], sizes["most"])
    kept = F.col("_row") == F.col("_last.row")
    return alone.unionByName(joined.select(id, *carry, F.col("_last.id").alias("keep_id"), "group_size", kept.alias("kept"), *shown))


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that are equal to another which stays; all columns but those named like ``MARKS``."""
    columns = [c for c in docs.columns if c.lower() not in MARKS]
    return mark(docs, id, text, [c for c in columns if c != id]).where("kept").select(*columns)


#: DuckDB SQL for the rows of ``mark`` with digests, of a table whose ids don't repeat.
SQL = f"""
WITH hashed AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')) AS text_sha256 FROM documents),
met AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM hashed GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM hashed JOIN met USING (text_sha256)"""
