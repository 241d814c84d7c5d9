"""Document fingerprints by a homomorphic multiset hash: the sum, modulo powers of two, of wide vectors hashed from paragraphs.

A paragraph's vector has two parts. EXACT lanes modulo 2 ** 32 come from a SHAKE-256 digest of the paragraph, so sums of different
multisets of paragraphs don't meet. SKETCH lanes modulo 2 ** 64 are the signed counts of the hashed, different word 3-grams of the
paragraph, so sums of similar multisets are near; no text is long enough to wrap one. Order doesn't matter, and a paragraph is inserted or
deleted by adding or subtracting its vector: ``fingerprint(a + newline + b) == add(fingerprint(a), fingerprint(b))``.

Likeness of two fingerprints is the cosine of their sketches, 1 for equal ones, at least 0. Paragraphs are the lines of a text.
Null text is an empty text, whose one paragraph is empty; it is like nothing but itself. Whole texts are read, however long. Empty tables
give empty results. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.shared import partitions, repeats, text_hash, text_parts
from statloom.llm.words import U64, mix, span_hashes, word_spans

EXACT, SKETCH = 16, 256
#: Rows of a result batch.
OUT_ROWS = 4096


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """EXACT and SKETCH lanes of each text's sum."""
    exact = np.zeros((len(texts), EXACT), np.uint32)
    for k, text in enumerate(texts):
        digests = b"".join(hashlib.shake_256(p.encode("utf-8", "surrogatepass")).digest(4 * EXACT) for p in text.split("\n"))
        exact[k] = np.frombuffer(digests, np.uint32).reshape(-1, EXACT).sum(0, dtype=np.uint32)
    raw, starts, ends, at = word_spans(pa.array(texts, pa.string()))
    words = span_hashes(raw, starts, ends)
    lines = np.concatenate([[0], np.cumsum(raw == 10)])[starts]
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    gram = words + U64(1)
    for k in (1, 2):
        past = np.zeros(len(words), U64)
        if len(words) > k:
            same = (lines[k:] == lines[:-k]) & (row[k:] == row[:-k])
            past[k:] = np.where(same, words[:-k], U64(0))
        gram = mix(gram + past * U64(2 * k + 1))
    # a paragraph's vector counts each of its 3-grams once, so that a repeated phrase doesn't outweigh the rest
    distinct = np.unique(mix(gram + (lines + row).astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)[1]
    gram, row = gram[distinct], row[distinct]
    lane = row * SKETCH + (gram >> U64(56)).astype(np.int64)
    sign = 1.0 - 2.0 * ((gram >> U64(8)) & U64(1)).astype(np.float64)
    sketch = np.bincount(lane, weights=sign, minlength=len(texts) * SKETCH).reshape(-1, SKETCH)
    return exact, np.rint(sketch).astype(np.int64)


def encode(exact: np.ndarray, sketch: np.ndarray) -> list[str]:
    """Fingerprints as text: how many bytes a sketch lane takes (the fewest of 1, 2, 4 and 8), and the lanes, little-endian, in base 64."""
    far = np.maximum(sketch.max(1), ~sketch.min(1)) if len(sketch) else np.zeros(0, np.int64)
    width = 1 << np.searchsorted([1 << 7, 1 << 15, 1 << 31], far, side="right")
    return [f"{w}{base64.b64encode(e.astype('<u4').tobytes() + s.astype(f'<i{w}').tobytes()).decode()}" for w, e, s in zip(width.tolist(), exact, sketch)]


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint[1:])
    return np.frombuffer(raw[: 4 * EXACT], "<u4"), np.frombuffer(raw[4 * EXACT :], f"<i{fingerprint[0]}").astype(np.int64)


def fingerprint(text: str | None) -> str:
    return encode(*vectors([text or ""]))[0]


def add(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint of both multisets of paragraphs together, or of a without b if sign is -1."""
    (ae, as_), (be, bs) = decode(a), decode(b)
    return encode((ae + np.uint32(sign & 0xFFFFFFFF) * be)[None], (as_ + sign * bs)[None])[0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Likeness of each row of a to the same row of b; both are (EXACT lanes, SKETCH lanes)."""
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    norm = np.sqrt((x**2).sum(1) * (y**2).sum(1))
    cosine = np.clip((x * y).sum(1) / np.maximum(norm, 1e-12), 0, 1)
    return np.where((a[0] == b[0]).all(1) & (a[1] == b[1]).all(1), 1.0, cosine)


def fingerprints(docs: DataFrame, column: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of every text."""
    keep = [c for c in docs.columns if c != column]
    schema = docs.select(*keep).schema.add(column, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch):
                found = encode(*vectors([x or "" for x in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(found, pa.string())], [*keep, column])

    return docs.select(*keep).mapInArrow(run, schema)


def _places(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Pairs of 64-bit numbers as byte strings of the same order."""
    both = np.stack([first, second], 1).astype(np.int64).view(U64) ^ U64(1 << 63)
    return np.ascontiguousarray(both.astype(">u8")).view("S16").ravel()


def _cuts(docs: DataFrame, n: int, sample: int) -> np.ndarray:
    """Places at which n ranges of about as much text begin, all but the first, from about ``sample`` rows; they only balance tasks."""
    some = docs.where(F.rand(3) < sample / max(1, docs.count()))
    some = some.select("first", "second", (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).cast("long").alias("bytes")).toArrow()
    places = _places(some["first"].to_numpy(), some["second"].to_numpy())
    order = np.argsort(places)
    upto = np.cumsum(some["bytes"].to_numpy()[order])
    return np.unique(places[order][np.searchsorted(upto, np.arange(1, n) * (upto[-1] / n))]) if len(order) else places


def _in_order(docs: DataFrame, sample: int) -> DataFrame:
    """docs(doc_id, text) in the order of doc_id (nulls first), a hash of the text, and the text, dealt to partitions that are ranges of it.

    Rows of a batch that are alike come once, with how ``many`` they are. Each range ends with a copy, ``extra``, of the row that comes
    after it: the first of the next range, the first of all after the last.
    """
    n = partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumns({"first": F.coalesce("doc_id", F.lit(-(1 << 63))), "second": text_hash(F.col("text"))})
    cuts = _cuts(docs, n, sample)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, int]] = {}
        for batch in batches:
            a, b = batch.column("first").to_numpy(), batch.column("second").to_numpy()
            order = np.lexsort((b, a))
            ranges, at = np.unique(np.searchsorted(cuts, _places(a, b), side="right")[order], return_index=True)
            for r, x, y in zip(ranges.tolist(), a[order][at].tolist(), b[order][at].tolist()):
                found[r] = min(found.get(r, (x, y)), (x, y))
        columns = [(r, *k) for r, k in found.items()]
        yield pa.RecordBatch.from_pylist([{"range": r, "first": x, "second": y} for r, x, y in columns], pa.schema([("range", pa.int32()), ("first", pa.int64()), ("second", pa.int64())]))

    heads = docs.select("first", "second").mapInArrow(least, "range int, first long, second long").groupBy("range").agg(F.min(F.struct("first", "second")).alias("head"))
    # as many rows as partitions, of three numbers
    heads = sorted((r["range"], *r["head"]) for r in heads.collect())
    head_places = _places(np.array([h[1] for h in heads], np.int64), np.array([h[2] for h in heads], np.int64))
    before = np.array([heads[k - 1][0] for k in range(len(heads))], np.int32)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch):
                a, b = part.column("first").to_numpy(), part.column("second").to_numpy()
                kept, many = repeats(part, [b, a])
                places = _places(a[kept], b[kept])
                ranges = np.searchsorted(cuts, places, side="right").astype(np.int32)
                head = np.minimum(np.searchsorted(head_places, places), len(head_places) - 1)
                is_head = np.flatnonzero(head_places[head] == places)
                for rows, times, where, extra in ((kept, many, ranges, False), (kept[is_head], many[is_head], before[head[is_head]], True)):
                    taken = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(times), pa.array(where), pa.array(np.full(len(rows), extra))], [*taken.schema.names, "many", "range", "extra"])

    schema = "doc_id long, text string, first long, second long, many long, range int, extra boolean"
    ranged = docs.mapInArrow(keyed, schema).repartitionById(n, F.col("range"))
    return ranged.sortWithinPartitions("range", "extra", "first", "second", F.col("text").asc_nulls_first())


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of the rows, of their edited texts and of the next rows; the last row read waits for the one after it.

    Of rows that are alike, each is the next of the one before.
    """
    waiting: tuple | None = None  # doc_id, text, how many, exact lanes, sketch lanes
    for batch in batches:
        for part in text_parts(batch):
            ids, extra, many = (part.column(c).to_pylist() for c in ("doc_id", "extra", "many"))
            texts = [x or "" for x in part.column("text").to_pylist()]
            exact, sketch = vectors(texts)
            if waiting is not None:
                ids, extra, texts, many = [waiting[0], *ids], [False, *extra], [waiting[1], *texts], [waiting[2], *many]
                exact, sketch = np.concatenate([waiting[3], exact]), np.concatenate([waiting[4], sketch])
            own = [k for k in range(len(ids) - 1) if not extra[k]]
            pairs = [(k, k, many[k] - 1) for k in own if many[k] > 1] + [(k, k + 1, 1) for k in own]
            if pairs:
                at, after, times = np.array(pairs).T
                edited = [texts[k][: len(texts[k]) - len(texts[k]) // 4] + texts[m][: len(texts[k]) // 4] for k, m in zip(at, after)]
                changed = vectors(edited)
                found = pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[k] for k in at], pa.int64()),
                        pa.array([len(texts[k]) for k in at], pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                        pa.array(encode(exact[at], sketch[at]), pa.string()),
                        pa.array(encode(*changed), pa.string()),
                        pa.array(likeness((exact[at], sketch[at]), changed)),
                        pa.array(likeness((exact[at], sketch[at]), (exact[after], sketch[after]))),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )
                upto = np.cumsum(times)
                for k in range(0, int(upto[-1]), OUT_ROWS):
                    yield found.take(pa.array(np.searchsorted(upto, np.arange(k, min(k + OUT_ROWS, int(upto[-1]))), side="right")))
            waiting = None if extra[-1] else (ids[-1], texts[-1], many[-1], exact[-1:], sketch[-1:])


def edited(docs: DataFrame, sample: int = 20_000) -> DataFrame:
    """Each document's fingerprint beside that of its edited text, in which the first code points of the next document (in the
    order of doc_id, nulls first, then a hash of the text; after the last comes the first) stand for the last quarter.

    docs: doc_id, text and further columns, which are ignored. A table of one row is its own next document. sample: about how many rows,
    taken at random, set the ranges of the tasks, of about as much text each; a run of one doc_id is cut between different texts.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _in_order(docs.select("doc_id", "text"), sample).select("doc_id", "text", "many", "extra").mapInArrow(_edits, schema)
