"""N-gram Jaccard join with Bayesian candidate pruning.

Texts with the same set of word 5-grams are one class from the start. Classes meet in bands of MinHash values; the values of a
meeting pair are compared a few at a time, and the pair is dropped once the posterior probability that its similarity reaches the
threshold falls below a tolerance. What remains is verified exactly on the 5-gram sets. Pairs of a hot band or group are never expanded into
rows: it is cut into blocks, each pair of blocks is one task's work, and only counts and spanning links leave it.

In groups of any size the pairs that meet in a band and outlast pruning are verified, and no others, so a pair's fate doesn't depend on the
corpus around it. What candidates join is verified together up to GIANT members. A larger group, which chains of weak links can make as large
as the corpus, is taken apart: each pair is verified in the first band that it shares, as stars where they are few for their members, else
block by block. Both give the same links.

Result, one row per document: ``class_id`` (least doc_id that verified links lead to), ``n_links`` (other documents at the
threshold or above, copies included) and ``copies`` (documents with the same 5-gram set).

Rows: null text is an empty text. A text without words links to nothing, not even to another one. Texts of under five words have
one n-gram, all their words; very long texts are read whole. Pairs at exactly the threshold are linked. Ties of classes go to the least doc_id. Of rows with one doc_id, that with the greatest key of its 5-gram set counts, once. Rows with a null
doc_id are left out. Empty tables give empty results; further columns are ignored by ``links`` and kept by ``representatives``.

A pair at exactly the threshold meets in a band with probability 1 - (1 - 0.8**4)**32 > 1 - 5e-8; the steps of
pruning together drop it with less than 9.2e-7 (TOLERANCE bounds the posterior at each step).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.components import components
from statloom.llm.shared import spread_join, stored, text_parts, unused
from statloom.llm.words import U64, mix, shingle_hashes, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
VALUES, ROWS = 128, 4
BANDS = VALUES // ROWS
STEP = 16
#: The bound of the posterior at each step; over all steps a pair at THRESHOLD is lost with probability 9.1e-7.
TOLERANCE = 1e-7
#: Members and shingles of a block: two blocks are one task's work. Members of a group that is verified block by block.
BLOCK = 2048
BLOCK_SHINGLES = 1 << 20
GIANT = 8192
#: Bits of the table that tells which documents are in no group, at most, and bits that mark a document.
MOST_BITS, MARKS = 26, 4
_random = np.random.default_rng(7)
_FACTOR = (_random.integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1)).reshape(-1, 1)
_SHIFT = _random.integers(0, 1 << 32, VALUES, dtype=np.uint32).reshape(-1, 1)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """VALUES minima of hashed shingles, their low 16 bits."""
    low = (shingles >> U64(32)).astype(np.uint32)
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 512):
        h = low[k : k + 512] * _FACTOR + _SHIFT
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(out, h.min(1), out=out)
    return out.astype(np.uint16)


@cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For 1, 2, ... compared steps: the fewest equal values with P(similarity >= threshold | matches) >= tolerance.

    The prior of the similarity is uniform, so the posterior is Beta(matches + 1, compared - matches + 1); its upper tail is
    integrated by Simpson's rule.
    """
    out = []
    x = np.linspace(threshold, 1, 2001)
    weight = np.where(np.arange(2001) % 2, 4.0, 2.0)
    weight[[0, -1]] = 1
    for n in range(STEP, VALUES + 1, STEP):
        for m in range(n + 1):
            a, b = m + 1, n - m + 1
            scale = lgamma(a + b) - lgamma(a) - lgamma(b)
            with np.errstate(divide="ignore", invalid="ignore"):
                density = np.exp(scale + m * np.log(x) + np.where(n - m, (n - m) * np.log1p(-x), 0.0))
            if (density * weight).sum() * (x[1] - x[0]) / 3 >= tolerance:
                break
        out.append(m)
    return tuple(out)


def prune(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a[i], b[j]) of MinHash rows that stay after comparing STEP values after STEP values."""
    same = np.zeros(len(i), np.int16)
    for k, least in enumerate(least_matches()):
        cut = slice(k * STEP, (k + 1) * STEP)
        same += (a[i, cut] == b[j, cut]).sum(1, dtype=np.int16)
        stay = same >= least
        i, j, same = i[stay], j[stay], same[stay]
    return i, j


def _key(shingles: np.ndarray) -> bytes:
    """A 128-bit hash of a set, the same in any order."""
    return np.array([shingles.sum(dtype=U64), mix(shingles * U64(3) + U64(1)).sum(dtype=U64)], U64).tobytes()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, the key of the shingle set, the MinHash values, and how many shingles; a text without words has none."""
    for batch in batches:
        for part in text_parts(batch):
            words, at = word_hashes(part.column("text"))
            key, values, n = [], [], []
            for a, b in zip(at[:-1], at[1:]):
                s = shingle_hashes(words[a:b], SHINGLE)
                n.append(len(s))
                key.append(_key(s) if len(s) else b"")
                values.append(minhash(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(key, pa.binary()), pa.array(values, pa.binary()), pa.array(n, pa.int32())], ["doc_id", "key", "values", "n"])


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    """The MARKS bits of a table of 2 ** bits that mark each id."""
    h = mix(ids.astype(np.int64).view(U64) + U64(1))
    return np.stack([mix(h + U64(k)) >> U64(64 - bits) for k in range(MARKS)])


def _marked(members: DataFrame, total: int) -> np.ndarray:
    """A table of 2 ** MOST_BITS bits at most, in words of 64, in which all bits that mark an id of members, total of them, are set."""
    bits = int(min(MOST_BITS, max(10, np.ceil(np.log2(total + 1)) + 4)))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.unique(_places(batch.column("id").to_numpy(), bits))
            word, first = np.unique(places >> U64(6), return_index=True)
            if len(word):
                set_ = np.bitwise_or.reduceat(U64(1) << (places & U64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(set_.view(np.int64))], ["word", "bits"])

    got = members.select("id").mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), U64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(U64)
    return out


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            values = np.frombuffer(b"".join(batch.column("values").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS)
            bands = _band_hashes(values)
            ids = np.repeat(batch.column("id").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(bands.reshape(-1))], ["id", "band"])


def _band_hashes(values: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bands of MinHash values (n, BANDS, ROWS), distinct from band to band."""
    h = np.arange(1, BANDS + 1, dtype=U64)[None, :]
    for r in range(ROWS):
        h = mix(h * U64(0x9E3779B97F4A7C15) + values[:, :, r].astype(U64))
    return h.view(np.int64)


def _upper(n: int, m: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of two blocks (each once within one block), a strip at a time."""
    for k in range(0, n, 64):
        i, j = np.meshgrid(np.arange(k, min(n, k + 64)), np.arange(m), indexing="ij")
        i, j = i.ravel(), j.ravel()
        yield (i[i < j], j[i < j]) if same else (i, j)


def _two_blocks(rows: pa.Table) -> tuple[pa.Table, pa.Table, bool]:
    """The rows of the two blocks of a group; a block that is paired with itself comes twice."""
    left, right = rows.column("left")[0].as_py(), rows.column("right")[0].as_py()
    if left == right:
        return rows, rows, True
    block = rows.column("block").to_numpy()
    return rows.filter(pa.array(block == left)), rows.filter(pa.array(block == right)), False


class _Forest:
    """Which nodes links have joined: root is the least node that each is joined to."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def apart(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = self.root[i] != self.root[j]
        return i[new], j[new]

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            i, j = self.apart(i, j)
            if not len(i):
                return
            a, b = self.root[i], self.root[j]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def _matrix(column: pa.ChunkedArray, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _meet(rows: pa.Table) -> pa.Table:
    """Links that join, within two blocks of one band, what pruning leaves together: one per class at most."""
    a, b, same = _two_blocks(rows)
    va, vb = _matrix(a.column("values"), np.uint16, VALUES), _matrix(b.column("values"), np.uint16, VALUES)
    ids = a.column("id").to_numpy() if same else np.concatenate([a.column("id").to_numpy(), b.column("id").to_numpy()])
    shift = 0 if same else len(va)
    forest = _Forest(len(ids))
    for i, j in _upper(len(va), len(vb), same):
        i, j = forest.apart(i, j + shift)
        i, j = prune(va, vb, i, j - shift)
        forest.link(i, j + shift)
    linked = forest.root != np.arange(len(ids))
    return pa.table({"u": ids[linked], "v": ids[forest.root[linked]]})


def _verify(rows: pa.Table) -> pa.Table:
    """Exact similarities within two blocks of one group of candidates: links counted per class, and spanning links."""
    return _counted(*_two_blocks(rows), None)


def _counted(a: pa.Table, b: pa.Table, same: bool, band: int | None) -> pa.Table:
    """id, links and root of the pairs of a and b, or within a, that meet in a band: first in the given one, if one is given."""
    va, vb = _matrix(a.column("values"), np.uint16, VALUES), _matrix(b.column("values"), np.uint16, VALUES)
    sa = [np.frombuffer(x.as_buffer(), U64) for x in a.column("shingles")]
    sb = sa if same else [np.frombuffer(x.as_buffer(), U64) for x in b.column("shingles")]
    ca, cb = a.column("copies").to_numpy(), b.column("copies").to_numpy()
    na, nb = a.column("n").to_numpy().astype(np.int64), b.column("n").to_numpy().astype(np.int64)
    ids = a.column("id").to_numpy() if same else np.concatenate([a.column("id").to_numpy(), b.column("id").to_numpy()])
    shift = 0 if same else len(sa)
    ha, hb = (_band_hashes(v.reshape(-1, BANDS, ROWS)) for v in (va, vb))
    links, forest = np.zeros(len(ids), np.int64), _Forest(len(ids))
    shared = _overlaps(sa, sb)
    for i, j in _upper(len(sa), len(sb), same):
        if band is not None:
            i, j = _first_shared(ha, hb, band, i, j)
        i, j = prune(va, vb, i, j)
        if band is None:
            met = _any_shared(ha, hb, i, j)
            i, j = i[met], j[met]
        both = shared(i, j)
        close = both * (1 + THRESHOLD) >= THRESHOLD * (na[i] + nb[j]) - 1e-9
        i, j = i[close], j[close]
        np.add.at(links, i, cb[j])
        np.add.at(links, j + shift, ca[i])
        forest.link(i, j + shift)
    return pa.table({"id": ids, "links": links, "root": ids[forest.root]})


def _overlaps(sa: list[np.ndarray], sb: list[np.ndarray]):
    """A function of pair indices: how many shingles two sets share. Shingles held by one set alone never count."""
    number, seen = np.unique(np.concatenate([*sa, *(sb if sb is not sa else [])]) if sa or sb else np.zeros(0, U64), return_counts=True)
    number = number[seen > 1]

    def index(sets: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for s in sets:
            at = np.searchsorted(number, s)
            at = at[at < len(number)]
            out.append(at[number[at] == s[: len(at)]] if len(at) else at)
        return out

    ia = index(sa)
    ib = ia if sb is sa else index(sb)
    mark = np.zeros(len(number) + 1, bool)

    def shared(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        if not len(i):
            return out
        order = np.argsort(i, kind="stable")
        cuts = np.flatnonzero(np.diff(i[order])) + 1
        for group in np.split(order, cuts):
            own = ia[i[group[0]]]
            mark[own] = True
            parts = [ib[k] for k in j[group]]
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            total = np.concatenate([[0], np.cumsum(mark[np.concatenate(parts)] if at[-1] else np.zeros(0, bool))])
            out[group] = total[at[1:]] - total[at[:-1]]
            mark[own] = False
        return out

    return shared


def _parts(size: Column, weight: Column) -> Column:
    """Into how many blocks of about BLOCK members and BLOCK_SHINGLES shingles a group is cut."""
    return F.greatest(F.ceil(size / BLOCK), F.ceil(weight / BLOCK_SHINGLES)).cast("int")


def _paired(members: DataFrame) -> DataFrame:
    """members(id, parts, ...) with the pairs of blocks of their group: each member comes once for each pair with its block."""
    cut = members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return cut.select("*", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")).drop("parts", "other", "size")


def _band_blocks(members: DataFrame, total: int) -> DataFrame:
    """members(id, values), at most total of them, by the bands that they share, in pairs of blocks: id, band, values, block, left, right."""
    bands = members.select("id", "values").mapInArrow(_bands, "id long, band long")
    sizes = bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").withColumn("parts", _parts(F.col("size"), F.lit(0)))
    met = spread_join(bands, sizes, "band", "size", F.xxhash64("id", "band"), BANDS * total)
    return _paired(met).join(members.select("id", "values"), "id")


def _sets_of(docs: DataFrame, members: DataFrame, total: int) -> DataFrame:
    """id, key and shingles of the documents of members(id, key), total of them, and of a few more, which a join drops: no text is shuffled,
    as those without a mark of a member go where they are read."""
    table = _marked(members, total)
    shipped = docs.sparkSession.sparkContext.broadcast(table)  # bounded by MOST_BITS; beyond, more of the others stay

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        bits = int(len(table)).bit_length() + 5
        for batch in batches:
            places = _places(batch.column("doc_id").to_numpy(), bits)
            maybe = (table[places >> U64(6)] >> (places & U64(63)) & U64(1)).all(0)
            for part in text_parts(batch.filter(pa.array(maybe))):
                words, at = word_hashes(part.column("text"))
                found = [shingle_hashes(words[a:b], SHINGLE) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([_key(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["id", "key", "shingles"])

    return docs.mapInArrow(sets, "id long, key binary, shingles binary").groupBy("id", "key").agg(F.first("shingles").alias("shingles"))


def _first_shared(a: np.ndarray, b: np.ndarray, band: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows a[i], b[j] of band hashes whose first common band is band."""
    where = np.flatnonzero(a[:1].ravel() == band) if len(a) else []
    for k in range(int(where[0]) if len(where) else 0):
        apart = a[i, k] != b[j, k]
        i, j = i[apart], j[apart]
    return i, j


def _any_shared(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the rows a[i], b[j] of band hashes have a band in common."""
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        s = slice(k, k + (1 << 16))
        out[s] = (a[i[s]] == b[j[s]]).any(1)
    return out


def _cells(rows: pa.Table) -> pa.Table:
    """Pairs of two blocks of a band that outlast pruning, and meet first in this band, as cells: the pairs between the members of
    side 0 and those of side 1, or among those of side 2.

    A cell is a star of one member and its partners if pairs are few, else all members that have a partner.
    """
    a, b, same = _two_blocks(rows)
    band, left, right = (rows.column(c)[0].as_py() for c in ("band", "left", "right"))
    va, vb = _matrix(a.column("values"), np.uint16, VALUES), _matrix(b.column("values"), np.uint16, VALUES)
    ha, hb = (_band_hashes(v.reshape(-1, BANDS, ROWS)) for v in (va, vb))
    found = [(np.zeros(0, np.int64),) * 2]
    for i, j in _upper(len(va), len(vb), same):
        found.append(prune(va, vb, *_first_shared(ha, hb, band, i, j)))
    i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    ids, others = a.column("id").to_numpy(), b.column("id").to_numpy()
    ours, theirs = np.unique(i), np.unique(j)
    if len(i) <= 4 * (len(ours) + len(theirs)):
        node, star = np.concatenate([ids[ours], others[j]]), np.concatenate([ours, i])
        side = np.repeat([0, 1], [len(ours), len(j)])
    elif same:
        node = ids[np.union1d(ours, theirs)]
        star, side = np.zeros(len(node), np.int64), np.full(len(node), 2)
    else:
        node, side = np.concatenate([ids[ours], others[theirs]]), np.repeat([0, 1], [len(ours), len(theirs)])
        star = np.zeros(len(node), np.int64)
    cell = [f"{band}:{left}:{right}:{k}" for k in star.tolist()]
    return pa.table({"cell": pa.array(cell, pa.string()), "band": pa.array(np.full(len(node), band)), "side": pa.array(side.astype(np.int32)), "id": node})


def _verify_cell(rows: pa.Table) -> pa.Table:
    """_verify for the pairs of a cell that meet first in its band."""
    side = rows.column("side").to_numpy()
    same = bool((side == 2).any())
    a, b = (rows, rows) if same else (rows.filter(pa.array(side == 0)), rows.filter(pa.array(side == 1)))
    return _counted(a, b, same, rows.column("band")[0].as_py())


def _giant_links(docs: DataFrame, giants: DataFrame, total: int) -> DataFrame:
    """id, links and root as _verify gives them, of members of groups too large to look at all their pairs."""
    cells = _band_blocks(giants, total).groupBy("band", "left", "right").applyInArrow(_cells, "cell string, band long, side int, id long")
    held = giants.select("id", "key", "values", "n", "copies").join(_sets_of(docs, giants, giants.count()), ["id", "key"])
    return cells.join(held, "id").groupBy("cell").applyInArrow(_verify_cell, "id long, links long, root long")


def links(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links and copies of every doc_id."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.mapInArrow(_sketch, "doc_id long, key binary, values binary, n int").groupBy("doc_id").agg(F.max(F.struct("key", "values", "n")).alias("s"))
    sketches = stored(rows.select("doc_id", "s.*"), "sketches")
    worded = sketches.where("n > 0")
    classes = stored(worded.groupBy("key").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("values").alias("values"), F.first("n").alias("n")), "classes")
    total = classes.count()
    candidates = _band_blocks(classes, total).groupBy("band", "left", "right").applyInArrow(_meet, "u long, v long")
    groups = components(candidates)
    members = stored(groups.select(F.col("node").alias("id"), F.col("root").alias("group")).join(classes, "id"), "members")
    sizes = members.groupBy("group").agg(F.count("*").alias("size"), _parts(F.count("*"), F.sum("n")).alias("parts"))
    grouped = spread_join(members, sizes, "group", "size", F.xxhash64("id"), total)
    usual = grouped.where(F.col("size") <= GIANT)
    pairs = _paired(usual).join(_sets_of(docs, members, members.count()), ["id", "key"])
    checked = pairs.groupBy("group", "left", "right").applyInArrow(_verify, "id long, links long, root long")
    if not sizes.where(F.col("size") > GIANT).isEmpty():
        checked = checked.union(_giant_links(docs, stored(grouped.where(F.col("size") > GIANT).drop("size", "parts"), "giants"), total))
    checked = stored(checked, "checked")
    counted = checked.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(checked.where("id != root").select(F.col("id").alias("u"), F.col("root").alias("v")))
    by_class = (
        classes.select("key", "id", "copies")
        .join(counted, "id", "left")
        .join(roots.withColumnRenamed("node", "id"), "id", "left")
        .select("key", "copies", F.coalesce("root", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    found = spread_join(worded.select("doc_id", "key"), stored(by_class, "by-class"), "key", "copies", F.unhex(F.md5(F.col("doc_id").cast("string"))), sketches.count())
    blank = sketches.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("copies"))
    return found.select("doc_id", "class_id", "n_links", "copies").union(blank)


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each class, that of the least doc_id; of rows with one doc_id, that of the least text. Documents without
    words or without a doc_id stay."""
    kept = links(docs).where("doc_id = class_id").select("doc_id")
    rank = unused(docs, "_rank")
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first())
    chosen = docs.join(kept, "doc_id", "left_semi").withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1)
    return chosen.select(*docs.columns).union(docs.where("doc_id is null"))


#: The same rows in DuckDB SQL, for tables whose pairs of documents that share a 5-gram are few enough.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, c = x.n AND c = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id WHERE r.root < l.b)
SELECT d.doc_id, (SELECT min(root) FROM r WHERE r.id = d.doc_id) AS class_id, coalesce(m.links, 0) AS n_links, 1 + coalesce(m.same, 0) AS copies
FROM documents d LEFT JOIN (SELECT a, count(*) AS links, count(*) FILTER (same) AS same FROM l GROUP BY a) m ON m.a = d.doc_id
"""
