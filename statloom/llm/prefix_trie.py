"""Prefix trie of conversations: a node for each distinct sequence of first turns, with what sharing it would save.

1. ``turn_arrays`` makes a conversation one binary value: for each turn 16 bytes of a SHA-256 of role and text, and 4 of the text's code points.
   Such values sort as the arrays of turns do, a prefix before what continues it.
2. All arrays are sorted over the cluster by ranges of (array, conv_id). Each task reads its range once: the LCP of neighbouring arrays closes
   the open intervals that are deeper and opens those that branch there; a stack holds what is open. An interval's nodes, all depths down to
   the interval that it lies in, have the same members and go out when it closes.
3. The prefixes of a range's first and last array may go on in the ranges beside it. A task hands them on as fragments with mergeable sums.
   The LCP over each boundary is the deepest prefix that the last fragments of one range and the first of the next share; it says
   which children two fragments have in common, whether a last array is a leaf, and what its successor saves. Fragments are added up by
   prefix. Children that closed below a fragment take its least member by a join.

Order of turns: turn (null first), then the hash. Null role and text are empty; rows without a conversation id are left out. Repeated rows are
repeated turns. An empty table gives no node. Any other column is ignored. A conversation's array is one value of 20 bytes a turn; its turns meet in
blocks of BLOCK turn numbers before they are shuffled by conversation. A task holds one open path, and of each open node that
began inside its range the closed children. The ids of members that end at a node are hashed in one pass, as SHA-256 has it: a run of more than
CHUNK ids, or one that touches the range's ends, comes as texts of CHUNK ids, which are hashed as they stream past.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.shared import partitions, spread_join, stored

#: Bytes of a turn in an array, and of its hash; turn numbers that are put together before the shuffle by conversation; ids in one text.
TURN, HASH, BLOCK, CHUNK = 20, 16, 1024, 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()
NODE, HANGING, FRAGMENT, ENDS = range(4)
_SCHEMA = (
    "kind int, pid int, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, parent_conv_id long, "
    "key binary, parent_key binary, on_first boolean, on_last boolean, before long, upto long, turn_hash binary"
)
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]
_ARROW = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[c.split()[1]]) for c in _SCHEMA.split(", ")])


def turn_hash(role: Column | str = "role", text: Column | str = "text") -> Column:
    """16 bytes that stand for a turn's role and text."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * HASH))


def turn_arrays(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and turns, the conversation's turns as one binary value."""
    size = F.unhex(F.lpad(F.hex(F.length(F.coalesce(text, F.lit("")))), 8, "0"))
    found = turn_hash(F.col(role), F.col(text))
    rows = turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("at"), F.concat(found, size).alias("one"))
    # turns without a number are ordered by hash alone, so its first byte makes blocks of them
    rows = rows.withColumns({"block": F.floor(F.col("at") / BLOCK), "part": F.when(F.col("at").isNull(), F.substring("one", 1, 1))})
    blocks = rows.groupBy("conv_id", "block", "part").agg(F.expr("listagg(one) WITHIN GROUP (ORDER BY at NULLS FIRST, one)").alias("some"))
    return blocks.groupBy("conv_id").agg(F.expr("listagg(some) WITHIN GROUP (ORDER BY block NULLS FIRST, part)").alias("turns"))


def branched(arrays: DataFrame, base: Column, kept: Column, most: int) -> DataFrame:
    """Each conversation with its first ``kept`` turns (``most`` at most) replaced by those of conversation ``base``, as far as that has them."""
    heads = arrays.select(F.col("conv_id").alias("_base"), F.substring("turns", 1, most * TURN).alias("_head"))
    asked = arrays.select("conv_id", "turns", base.alias("_of"), (kept * TURN).cast("int").alias("_kept"))
    bases = asked.select(F.col("_of").alias("_base")).distinct()
    found = asked.join(heads.join(bases, "_base", "left_semi"), F.col("_of") == F.col("_base"), "left")
    head = F.substring(F.coalesce("_head", F.lit(b"")), F.lit(1), F.col("_kept"))
    return found.select("conv_id", F.concat(head, F.substring("turns", F.col("_kept") + 1, F.octet_length("turns"))).alias("turns"))


@dataclass(slots=True)
class _Open:
    """An open interval of the sorted arrays: members that share the first ``depth`` turns of path."""

    depth: int
    path: bytes
    totals: list[int]  # code points of the first 0, 1, ... turns of path
    n: int
    least: int
    children: int = 0
    leaves: int = 0
    saved: int = 0  # for each member but the first: code points of what it shares with the one before it
    left: bool = False  # it holds the range's first array
    ends: str | None = NOTHING  # None: comes from texts of ids
    held: list[list] = field(default_factory=list)  # closed children that wait for its least member

    def key(self) -> bytes:
        return hashlib.blake2b(self.path[: self.depth * TURN], digest_size=HASH).digest()


def _shared(a: bytes, b: bytes) -> int:
    """How many first turns of a and b are the same."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TURN
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) // TURN


class _Sweep:
    """One range of sorted arrays: nodes that are complete, nodes whose parent is a fragment, fragments, and texts of ids."""

    def __init__(self, pid: int):
        self.pid = pid
        self.stack: list[_Open] = []
        self.out: list[list] = []
        self.last: bytes | None = None
        self.ids: list[str] = []  # of the run of equal arrays that is being read
        self.in_texts = False  # whether the run's ids go out as texts
        self.texts = 0

    def add(self, turns: bytes, ids: list[int]) -> None:
        """Equal arrays, in ascending order of id."""
        if turns == self.last:
            top = self.stack[-1]
            top.n += len(ids)
            top.saved += len(ids) * top.totals[top.depth]
        else:
            if self.last is not None:
                self._end_run()
            depth = len(turns) // TURN
            sizes = np.frombuffer(turns, np.uint8).reshape(depth, TURN)[:, HASH:].copy().view(">u4").ravel()
            totals = [0, *np.cumsum(sizes, dtype=np.int64).tolist()]
            if self.last is not None:
                shared = _shared(self.last, turns)
                self._close_below(shared)
                self.stack[-1].children += 1
                self.stack[-1].saved += totals[shared]
            self.stack.append(_Open(depth, turns, totals, len(ids), ids[0], saved=(len(ids) - 1) * totals[depth], left=self.last is None))
            self.in_texts = self.last is None
            self.last = turns
        self.ids += map(str, ids)
        while len(self.ids) > CHUNK:
            self.in_texts = True
            self._text(self.ids[:CHUNK])
            del self.ids[:CHUNK]

    def finish(self) -> None:
        if not self.stack:
            return
        self.in_texts = True
        self._end_run()
        while self.stack:
            e = self.stack.pop()
            self._fragments(e, self.stack[-1].depth if self.stack else -1, True)
            if self.stack:
                self._merge(e, self.stack[-1])

    def _text(self, ids: list[str]) -> None:
        self.texts += 1
        self.out.append([ENDS, self.pid, self.texts, None, None, None, None, None, ",".join(ids), None, self.stack[-1].key(), *[None] * 6])

    def _end_run(self) -> None:
        top = self.stack[-1]
        if self.in_texts:
            self._text(self.ids)
            top.ends = None
        else:
            top.ends = hashlib.sha256(",".join(self.ids).encode()).hexdigest()
        self.ids = []

    @staticmethod
    def _merge(e: _Open, into: _Open) -> None:
        into.n += e.n
        into.least = min(into.least, e.least)
        into.leaves += e.leaves
        into.saved += e.saved

    def _close_below(self, shared: int) -> None:
        """Close what is deeper than shared; an interval of that depth is on top then."""
        while self.stack[-1].depth > shared:
            e = self.stack.pop()
            if not e.children:
                e.leaves = 1
            above = self.stack[-1] if self.stack and self.stack[-1].depth >= shared else None
            low = above.depth if above else shared
            if above:
                self._merge(e, above)
            else:
                above = _Open(shared, e.path, e.totals, e.n, e.least, 1, e.leaves, e.saved, e.left)
                self.stack.append(above)
            if e.left:
                self._fragments(e, low, False)
            else:
                self._nodes(e, low, above)

    def _row(self, e: _Open, depth: int, kind: int) -> list:
        whole = depth == e.depth
        before = e.totals[depth - 1] if depth else 0
        saved = e.saved if kind == FRAGMENT else e.saved - (e.n - 1) * before
        ends = e.ends if whole else NOTHING
        turn = e.path[(depth - 1) * TURN : (depth - 1) * TURN + HASH] if depth else None
        return [kind, self.pid, depth, e.least, e.n, e.children if whole else 1, e.leaves, saved, ends, None, None, None, None, None, before, e.totals[depth], turn]

    def _nodes(self, e: _Open, low: int, above: _Open) -> None:
        """The nodes of an interval inside the range, from the deepest to the one that hangs on ``above``."""
        for row in e.held:
            row[9] = e.least
        self.out += e.held
        for depth in range(e.depth, low, -1):
            row = self._row(e, depth, NODE)
            if row[8] is None:
                row[10] = e.key()
            row[9] = e.least  # the parent has the same members
            self.out.append(row)
        row = self.out.pop()  # but for the uppermost
        row[9] = None
        if above.left:
            row[0], row[11] = HANGING, above.key()
            self.out.append(row)
        else:
            above.held.append(row)

    def _fragments(self, e: _Open, low: int, on_last: bool) -> None:
        state = hashlib.blake2b(e.path[: max(low, 0) * TURN], digest_size=HASH)
        parent = state.digest() if low >= 0 else None
        for depth in range(low + 1, e.depth + 1):
            state.update(e.path[max(depth - 1, 0) * TURN : depth * TURN])
            row = self._row(e, depth, FRAGMENT)
            row[8] = e.ends if depth == e.depth and e.ends != NOTHING else None
            row[10:14] = [state.digest(), parent, e.left, on_last]
            self.out.append(row)
            parent = row[10]
        for row in e.held:
            row[0], row[11] = HANGING, parent
        self.out += e.held


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sweep = _Sweep(TaskContext.get().partitionId())

    def handed() -> pa.RecordBatch:
        rows, sweep.out = sweep.out, []
        return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

    for batch in batches:
        turns, ids = batch.column("turns").to_pylist(), batch.column("conv_id").to_pylist()
        at = 0
        while at < len(ids):
            to = at + 1
            while to < len(ids) and turns[to] == turns[at]:
                to += 1
            sweep.add(turns[at], ids[at:to])
            at = to
            if len(sweep.out) > 1 << 14:
                yield handed()
    sweep.finish()
    if sweep.out:
        yield handed()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each key's texts, sorted by key and place, joined by commas."""
    key, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "found"])

    for batch in batches:
        for own, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if own == key:
                state.update(b",")
            else:
                if key is not None:
                    yield done()
                key, state = own, hashlib.sha256()
            state.update(text.encode())
    if key is not None:
        yield done()


def nodes(arrays: DataFrame) -> DataFrame:
    """The nodes of the trie of conv_id and turns (of ``turn_arrays``, ids not repeated).

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and turn_hash of the last turn.
    """
    spark = arrays.sparkSession
    arrays = stored(arrays, "trie-arrays")  # Spark reads them twice, to find ranges and to deal them
    ordered = arrays.repartitionByRange(partitions(spark), "turns", "conv_id").sortWithinPartitions("turns", "conv_id")
    swept = stored(ordered.mapInArrow(_swept, _SCHEMA), "trie-sweep")
    fragments = swept.where(F.col("kind") == FRAGMENT)

    # a row for each range: what it shares with the one before, and whether its last array is a leaf
    by_range = Window.orderBy("pid")
    ranges = fragments.where("on_last").groupBy("pid").agg(F.max("depth").alias("deepest")).withColumn("previous", F.lag("pid").over(by_range))
    firsts = fragments.where("on_first").select("pid", "key", "depth", "upto").join(ranges.select("pid", "previous"), "pid")
    lasts = fragments.where("on_last").select(F.col("pid").alias("previous"), "key")
    common = firsts.join(lasts, ["previous", "key"]).groupBy("pid").agg(F.max("depth").alias("common"), F.max("upto").alias("common_upto"))
    bounds = ranges.join(common, "pid", "left").select("pid", "deepest", F.coalesce("common", F.lit(-1)).alias("common"), F.coalesce("common_upto", F.lit(0)).alias("common_upto"))
    bounds = bounds.withColumn("leaf", F.coalesce(F.lead("common").over(by_range) < F.col("deepest"), F.lit(True)))

    met = fragments.join(bounds, "pid")
    none = F.lit(0)
    spine = met.groupBy("key").agg(
        F.max("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.sum(F.col("n_children") - F.when(F.col("on_first") & (F.col("common") > F.col("depth")), 1).otherwise(none)).alias("n_children"),
        F.sum(F.col("n_leaves") + F.when(F.col("on_last") & F.col("leaf"), 1).otherwise(none)).alias("n_leaves"),
        (F.sum(F.col("saved_tokens") + F.when(F.col("on_first") & (F.col("common") >= F.col("depth")), F.col("common_upto")).otherwise(none)) - (F.sum("n_convs") - 1) * F.max("before")).alias("saved_tokens"),
        F.max("ends").alias("ends"),
        F.max("parent_key").alias("parent_key"),
        F.max("turn_hash").alias("turn_hash"),
    )
    spine = stored(spine, "trie-spine")
    names = spine.select("key", F.col("conv_id").alias("parent_conv_id"))
    known = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "turn_hash", "key"]
    upper = spine.join(names.withColumnRenamed("key", "parent_key"), "parent_key", "left").select(*known)

    hanging = swept.where(F.col("kind") == HANGING).drop("parent_conv_id")
    parents = stored(hanging.groupBy("parent_key").agg(F.count("*").alias("size")).join(names.withColumnRenamed("key", "parent_key"), "parent_key"), "trie-parents")
    sizes = parents.agg(F.coalesce(F.sum("size"), none).alias("total"), F.coalesce(F.max("size"), none).alias("most")).first()
    own = F.unhex(F.hex(F.xxhash64("conv_id", "depth")))
    below = spread_join(hanging, parents, "parent_key", "size", own, sizes["total"], sizes["most"]).select(*known)

    texts = swept.where(F.col("kind") == ENDS).select("key", "pid", "depth", "ends").repartition("key").sortWithinPartitions("key", "pid", "depth")
    digests = texts.mapInArrow(_hashed, "key binary, found string")
    every = swept.where(F.col("kind") == NODE).select(*known).unionByName(below).unionByName(upper)
    without = every.where("ends is null").join(digests, "key", "left").withColumn("ends", F.coalesce("found", F.lit(NOTHING)))
    done = every.where("ends is not null").select(*known[:-1]).unionByName(without.select(*known[:-1]))
    return done.withColumnRenamed("ends", "ends_sha256").select(*known[:7], "ends_sha256", "turn_hash")


def with_turns(found: DataFrame, turns: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Nodes with the role and text of their last turn (nulls as they are; of turns alike but for null and empty, one of them); null for the root."""
    said = turns.select(turn_hash(F.col(role), F.col(text)).alias("turn_hash"), F.col(role).alias("role"), F.col(text).alias("text"))
    said = said.groupBy("turn_hash").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    return found.join(said, "turn_hash", "left")


#: DuckDB's crc32 of the decimal text of {0}: a step for each byte, and one for each of its bits.
_CRC = "xor(list_reduce(list_prepend(4294967295, flatten([[ord(c)] || [-1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(CAST({0} AS VARCHAR), '')])::BIGINT[]), lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END), 4294967295)"
#: DuckDB SQL for the nodes of the conversations, rebuilt as the query does it.
SQL = f"""
WITH said AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS hash FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT conv_id, hash, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, hash) AS pos FROM said),
ids AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC.format("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (SELECT ids.conv_id, 0 AS own, pos, hash, n FROM ids JOIN turns ON turns.conv_id = base AND pos <= h
  UNION ALL SELECT ids.conv_id, 1, pos, hash, n FROM ids JOIN turns ON turns.conv_id = ids.conv_id AND pos > h),
arrays AS (SELECT ids.conv_id, coalesce(list(hash ORDER BY own, pos) FILTER (hash IS NOT NULL), []) AS path, coalesce(list(n ORDER BY own, pos) FILTER (hash IS NOT NULL), []) AS sizes FROM ids LEFT JOIN rebuilt ON rebuilt.conv_id = ids.conv_id GROUP BY ids.conv_id),
keyed AS (SELECT conv_id, sizes, len(path) AS size, [sha256(array_to_string(path[1:d], ',')) for d in range(0, len(path) + 1)] AS keys FROM arrays),
prefixes AS (SELECT conv_id, size, unnest(range(0, size + 1)) AS d, unnest(keys) AS key, unnest(list_prepend(0, sizes)) AS n, unnest(list_prepend(NULL, keys[:-2])) AS up FROM keyed),
grouped AS (SELECT key, any_value(d) AS depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256 FROM prefixes GROUP BY key),
grown AS (SELECT up AS key, count(*) AS n_children FROM grouped WHERE up IS NOT NULL GROUP BY up),
known AS (SELECT grouped.*, coalesce(n_children, 0) AS n_children FROM grouped LEFT JOIN grown USING (key)),
below AS (SELECT unnest(keys[:depth + 1]) AS key, n_children, (n_convs - 1) * n AS saved FROM known JOIN keyed USING (conv_id)),
summed AS (SELECT key, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM below GROUP BY key)
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves, saved_tokens, a.ends_sha256
FROM known a JOIN summed ON summed.key = a.key LEFT JOIN known b ON b.key = a.up"""
