"""Alignment of two tokenizers over a corpus: where their tokens end together, which tokens overlap, and how often each pair of ids does.

A is a byte-level tokenizer, which reads a space and the text; B a sentence-piece model, which adds that space itself. Both read texts as
they are, without special tokens: such strings inside a text are plain text. The tokens of both are runs of the same bytes. Running sums of
their lengths are the offsets where tokens end; offsets that both have cut a text into groups, and a link is a pair of tokens, one of
each, whose bytes overlap.

1. ``encode`` writes a row for each document: its ids, 16 bits an id, with the counts and the digest of its groups.
2. ``pair_counts`` counts the links of each pair of ids over all rows: tasks add up theirs, then sums are shuffled by pair and salt, then
   by pair. The pair of the highest count of each id of B (ties included) is marked as its best.
3. ``with_counts`` looks every link's pair up and adds up by document. Up to LOOKUP pairs, as counted, go to the tasks as a sorted table of
   52 MB at most; beyond that, pairs counted by document are joined with the counts, hot pairs without meeting in one task. Both give the same.

Null and empty texts, and those whose bytes either tokenizer doesn't keep (a U+2581 becomes a space), have no tokens: zeros, and an empty
string instead of a digest. Texts are read whole; what is held of a text is in proportion to its length. Repeated rows count as often as they are
there. Empty tables give no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.shared import segment_sum, spread_join, stored, text_parts

#: Pairs in a broadcast table; shares that a pair's sums are dealt to first; places of an id of B in the number of a pair.
LOOKUP, SALTS, WIDTH = 1 << 22, 16, 1 << 16
#: Pieces that a worker keeps the ids of; the longest that is kept; how many are encoded in one text; pairs that a task adds up before it hands them on.
KEEP, LONGEST, LINE, GATHERED = 400_000, 64, 512, 1 << 21
SPACE = "▁"
#: The characters of Unicode's property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: How byte-level tokenizers split a text before they merge bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts that both ways of encoding must agree on.
PROBES = (" a  b\n\nc\td", " don't I'LL 12 345x", " Éa ß 日本語 テスト 🎉", " <|endoftext|>", " \u2003x\x1cy", "")
_BYTE = re.compile("<0x([0-9A-F]{2})>")


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, all others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = (b for b in range(256) if b not in printable)
    return {chr(b): b for b in sorted(printable)} | {chr(256 + k): b for k, b in enumerate(other)}


def _ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start[i]:start[i] + size[i]] for all i, one after the other."""
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)]


class Pair:
    """Two tokenizers, and the ids of pieces met before.

    A text is cut where white space follows other characters. No token of A reaches over such a place; none of B does if its pieces have
    no white space but the mark of a space, and that at their beginning. This is read off B's vocabulary; a text with white space that
    occurs in its pieces is a piece itself.
    """

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks of an executor share its cores already
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        alphabet, vocabulary = _byte_alphabet(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(SPACE, " ").encode() for p in pieces]
        if max(len(self.a_bytes), len(self.b_bytes)) > WIDTH:
            raise ValueError("vocabularies of more than 65,536 ids don't fit 16 bits")
        self.a_size, self.b_size = (np.array([len(x) for x in known], np.int64) for known in (self.a_bytes, self.b_bytes))
        normal = [p for p in pieces if not _BYTE.fullmatch(p)]
        inside = {c for p in normal for c in p if c in WHITE}
        whole = not isinstance(self.a.pre_tokenizer, pre_tokenizers.ByteLevel) or any(SPACE in p.lstrip(SPACE) for p in normal) or self.a.normalizer is not None
        self.uncut = re.compile("" if whole else "[" + re.escape("".join(sorted(inside | {SPACE}))) + "]")
        self.piece = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.blank = self.b.piece_to_id(SPACE)
        self.fast = None if whole else self._same_merges(a)
        self.forget()

    def _same_merges(self, path: str):
        """A's merges in a library that is three times as fast, if the ids are in the order of merges; else None."""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ranks = {x: k for k, x in enumerate(self.a_bytes) if x}
        merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        if None in merged or merged != sorted(merged) or len(ranks) < len(self.a_bytes):
            return None
        special = [k for k, x in self.a.get_added_tokens_decoder().items()]
        fast = tiktoken.Encoding("merges", pat_str=SPLIT, mergeable_ranks={x: k for x, k in ranks.items() if k not in special}, special_tokens={})
        return fast if [fast.encode_ordinary(t) for t in PROBES] == [self.a.encode(t, add_special_tokens=False).ids for t in PROBES] else None

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = [np.zeros(1 << 16, np.uint16), np.zeros(1 << 16, np.uint16)]
        self.used = [0, 0]
        self.start, self.size, self.kept = np.zeros((2, 1 << 12), np.int64), np.zeros((2, 1 << 12), np.int64), np.zeros(1 << 12, bool)

    def _b_ids(self, pieces: list[str]) -> list[np.ndarray]:
        """B's ids of pieces as they stand, which the model would put a space before."""
        asked = [p[1:] if p[0] == " " else p for p in pieces]
        found = self.b.encode(asked, num_threads=1)
        return [np.array(ids if p[0] == " " and len(p) > 1 else [self.blank] if p == " " else ids[1:], np.int64) for p, ids in zip(pieces, found)]

    def _alone(self, pieces: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        a = [self.fast.encode_to_numpy(p) for p in pieces] if self.fast else [np.array(e.ids, np.int64) for e in self.a.encode_batch(pieces, add_special_tokens=False)]
        return a, self._b_ids(pieces)

    def _together(self, pieces: list[str]) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Ids of A and of B, with their counts by piece, of pieces that may stand behind one another; None if that shows in the bytes."""
        lines = ["".join(pieces[k : k + LINE]) for k in range(0, len(pieces), LINE)]
        raw = "".join(pieces).encode()
        ends = np.cumsum([len(p.encode()) for p in pieces])
        out = []
        for found, size, known in zip(self._alone(lines), (self.a_size, self.b_size), (self.a_bytes, self.b_bytes)):
            ids = np.concatenate(found).astype(np.int64)
            upto = np.cumsum(size[ids])
            at = np.searchsorted(upto, ends)
            if not len(ids) or at[-1] >= len(ids) or (upto[at] != ends).any() or b"".join(map(known.__getitem__, ids.tolist())) != raw:
                return None
            out.append((ids, np.diff(at, prepend=-1)))
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Give the pieces the next numbers, and keep their ids."""
        plain = [p for p in pieces if len(p) <= LONGEST and p[-1] not in WHITE and SPACE not in p]
        both = self._together(plain) if plain else None
        if both:
            self._keep(plain, both, np.ones(len(plain), bool))
            pieces = [p for p in pieces if p not in self.known]
        if pieces:
            found = self._alone(pieces)
            a, b = self.a_bytes, self.b_bytes
            kept = [b"".join(map(a.__getitem__, x.tolist())) == (raw := p.encode()) and b"".join(map(b.__getitem__, y.tolist())) == raw for p, x, y in zip(pieces, *found)]
            self._keep(pieces, [(np.concatenate(x), np.fromiter(map(len, x), np.int64, len(x))) for x in found], kept)

    def _keep(self, pieces: list[str], both: list[tuple[np.ndarray, np.ndarray]], kept) -> None:
        first = len(self.known)
        last = first + len(pieces)
        self.known.update(zip(pieces, range(first, last)))
        while last > len(self.kept):
            self.start, self.size, self.kept = (np.concatenate([x, np.zeros_like(x)], axis=-1) for x in (self.start, self.size, self.kept))
        for side, (ids, size) in enumerate(both):
            used = self.used[side]
            while used + len(ids) > len(self.flat[side]):
                self.flat[side] = np.concatenate([self.flat[side], np.zeros_like(self.flat[side])])
            self.flat[side][used : used + len(ids)] = ids
            self.start[side, first:last] = used + np.cumsum(size) - size
            self.size[side, first:last] = size
            self.used[side] += len(ids)
        self.kept[first:last] = kept

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B of all texts, one after the other, and how many of each a text has; none of what isn't kept as it is."""
        if len(self.known) > KEEP:
            self.forget()
        cut = [[] if not t else [f" {t}"] if self.uncut.search(t) else self.piece.findall(f" {t}") for t in texts]
        new = set().union(*cut).difference(self.known)
        long = [p for p in new if len(p) > LONGEST]
        new.difference_update(long)
        if new:
            self._learn(list(new))
        before = list(self.used)
        if long:
            self._learn(long)
        codes = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64)
        rows = np.repeat(np.arange(len(texts)), [len(pieces) for pieces in cut])
        bad = np.bincount(rows[~self.kept[codes]], minlength=len(texts)) > 0
        codes, rows = codes[~bad[rows]], rows[~bad[rows]]
        ids = [_ragged(self.flat[side], self.start[side, codes], self.size[side, codes]) for side in (0, 1)]
        counts = [np.bincount(rows, self.size[side, codes], len(texts)).astype(np.int64) for side in (0, 1)]
        for p in long:  # what is long takes much room, and is seldom met again
            del self.known[p]
        self.used = before
        return *ids, *counts


_pairs: dict[tuple[str, str], Pair] = {}


def pair_of(a: str, b: str) -> Pair:
    """One for each worker process and pair of files: what it has learned serves all tasks of the worker."""
    if (a, b) not in _pairs:
        _pairs[a, b] = Pair(a, b)
    return _pairs[a, b]


def cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The offsets where tokens of both end; both arrays ascend and end alike."""
    return np.intersect1d(ends_a, ends_b, assume_unique=True)


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (of A, of B) of all pairs of tokens that overlap, in order."""
    begins = np.concatenate([[0], ends_a[:-1]]) if len(ends_a) else ends_a
    first = np.searchsorted(ends_b, begins, side="right")
    count = np.searchsorted(ends_b, ends_a, side="left") - first + 1
    total = np.cumsum(count)
    of_a = np.repeat(np.arange(len(ends_a)), count)
    return of_a, np.arange(len(of_a)) + np.repeat(first - total + count, count)


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of 0 to n - 1, with a place for a mark after them, as rows of bytes, and how many digits each has."""
    digits = np.arange(n).astype(str)
    width = max(1, len(str(n - 1)))
    size = np.char.str_len(digits)
    rows = np.zeros((n, width + 1), np.uint8)
    rows[:, :width] = np.frombuffer(np.char.encode(digits, "ascii").astype(f"S{width}").tobytes(), np.uint8).reshape(n, width)
    return rows, size


_DIGITS, _SIZES = _decimals(WIDTH)


def group_texts(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, docs: int, doc_a: np.ndarray, doc_b: np.ndarray) -> list[bytes]:
    """For each document ``a1,a2|b1;a3|b2,b3``: ids of A, then of B, of each group in order. group_*: the group of each token, ascending."""
    ids, group, doc = np.concatenate([a, b]), np.concatenate([group_a, group_b]), np.concatenate([doc_a, doc_b])
    side = np.repeat([0, 1], [len(a), len(b)])
    order = np.argsort(group * 2 + side, kind="stable")
    ids, group, side, doc = ids[order], group[order], side[order], doc[order]
    last = np.ones(len(ids), bool)  # of its group and side
    last[:-1] = (group[1:] != group[:-1]) | (side[1:] != side[:-1])
    mark = np.where(last, np.where(side == 0, ord("|"), ord(";")), ord(",")).astype(np.uint8)
    size = _SIZES[ids]
    rows = _DIGITS[ids]
    rows[np.arange(len(ids)), size] = mark
    raw = rows[np.arange(rows.shape[1]) <= size[:, None]].tobytes()
    ends = np.cumsum(np.bincount(doc, size + 1, docs).astype(np.int64)).tolist()
    return [raw[x : y - 1] for x, y in zip([0, *ends], ends)]  # without the last mark


def encode(docs: DataFrame, a: str, b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups_sha256, and the ids of A and of B as little-endian unsigned 16-bit bytes, stored."""
    schema = docs.select(id).schema
    for name, kind in (("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("groups_sha256", "string"), ("a", "binary"), ("b", "binary")):
        schema = schema.add(name, kind)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair_of(a, b)
        for batch in batches:
            for part in text_parts(batch, "_text"):
                n = part.num_rows
                ids_a, ids_b, n_a, n_b = both.encode(part.column("_text").to_pylist())
                ends_a, ends_b = np.cumsum(both.a_size[ids_a]), np.cumsum(both.b_size[ids_b])
                common = cuts(ends_a, ends_b)
                doc_a, doc_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
                group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
                groups = np.bincount(doc_a[np.searchsorted(ends_a, common)], minlength=n) if len(common) else np.zeros(n, np.int64)
                texts = group_texts(ids_a, ids_b, group_a, group_b, n, doc_a, doc_b)
                # neighbouring tokens of a group share one boundary each: a tokens and b tokens have a + b - 1 links
                links = n_a + n_b - groups
                sha = [hashlib.sha256(x).hexdigest() if k else "" for x, k in zip(texts, n_a)]
                raw = [_binary(x, k) for x, k in ((ids_a, n_a), (ids_b, n_b))]
                yield pa.RecordBatch.from_arrays([part.column("_id"), *(pa.array(x, pa.int64()) for x in (n_a, n_b, groups, links)), pa.array(sha, pa.string()), *raw], schema.names)

    found = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).mapInArrow(encoded, schema)
    return stored(found.withColumn("_row", F.monotonically_increasing_id()), "alignment", compression="zstd")


def _binary(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts) * 2])
    raw = ids.astype("<u2").tobytes()
    return pa.array([raw[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())


def _links(batch: pa.RecordBatch, both: Pair) -> tuple[np.ndarray, np.ndarray]:
    """The row and the pair of ids (A's times WIDTH plus B's) of each link of stored rows."""
    ids = []
    for side in ("a", "b"):
        ids.append(np.frombuffer(b"".join(batch.column(side).to_pylist()), "<u2"))
    rows = np.repeat(np.arange(batch.num_rows), batch.column("n_a").to_numpy(zero_copy_only=False))
    of_a, of_b = overlaps(np.cumsum(both.a_size[ids[0]]), np.cumsum(both.b_size[ids[1]]))
    return rows[of_a], ids[0][of_a].astype(np.int64) * WIDTH + ids[1][of_b]


def _some_rows(batches: Iterator[pa.RecordBatch], bytes_of_ids: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about so many bytes of ids, or one row."""
    for batch in batches:
        size = (batch.column("n_a").to_numpy(zero_copy_only=False) + batch.column("n_b").to_numpy(zero_copy_only=False)) * 2
        block = np.cumsum(size) // bytes_of_ids
        at = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [batch.num_rows]])
        for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
            if y > x:
                yield batch.slice(x, y - x)


def _added(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(pairs), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


def pair_counts(rows: DataFrame, a: str, b: str) -> DataFrame:
    """pair, n (its links in all rows) and best (whether no pair of its id of B has more), stored."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, salt = pair_of(a, b), TaskContext.get().partitionId() % SALTS
        pairs: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(np.full(len(pairs[0]), salt, np.int32)), pa.array(counts[0])], ["pair", "salt", "n"])

        for batch in _some_rows(batches):
            found, n = np.unique(_links(batch, both)[1], return_counts=True)
            pairs.append(found)
            counts.append(n)
            if sum(map(len, pairs[1:])) > len(pairs[0]):  # merged when as much again has come
                merged = _added(pairs, counts)
                pairs, counts = [merged[0]], [merged[1]]
                if len(pairs[0]) > GATHERED:
                    yield handed()
                    pairs, counts = [], []
        if pairs:
            merged = _added(pairs, counts)
            pairs, counts = [merged[0]], [merged[1]]
            yield handed()

    part = rows.where("n_a > 0").select("n_a", "n_b", "a", "b").mapInArrow(counted, "pair long, salt int, n long")
    sums = part.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))
    sums = stored(sums, "alignment-sums")
    highest = sums.groupBy((F.col("pair") % WIDTH).alias("id_b")).agg(F.max("n").alias("most"))  # one row for each id of B at most
    best = sums.join(F.broadcast(highest), F.col("pair") % WIDTH == F.col("id_b"))
    return best.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(rows: DataFrame, counts: DataFrame, a: str, b: str) -> DataFrame:
    """_row, n_best and count_sum of the rows that have tokens."""
    schema = "_row long, n_best long, count_sum long"
    asked = rows.where("n_a > 0").select("_row", "n_a", "n_b", "a", "b")
    stats = counts.agg(F.count("*").alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    if stats["n"] <= LOOKUP:
        held = counts.toArrow().sort_by("pair")
        arrays = [held["pair"].to_numpy(), held["n"].to_numpy(), held["best"].to_numpy()]
        return asked.mapInArrow(_looked_up(rows.sparkSession.sparkContext.broadcast(arrays), a, b), schema)

    def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair_of(a, b)
        for batch in _some_rows(batches):
            row, pair = _links(batch, both)
            order = np.lexsort((pair, row))
            row, pair = row[order], pair[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])]))
            times = np.diff(np.concatenate([first, [len(row)]]))
            yield pa.RecordBatch.from_arrays([batch.column("_row").take(pa.array(row[first])), pa.array(pair[first]), pa.array(times)], ["_row", "pair", "times"])

    held = asked.mapInArrow(by_document, "_row long, pair long, times long")
    # a row takes a pair once: as many rows as links at most; hot pairs' rows are dealt by numbers that no pair has
    joined = spread_join(held, counts, "pair", "n", -1 - F.col("_row"), stats["total"], stats["most"])
    return joined.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))


def _looked_up(shipped, a: str, b: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair_of(a, b)
        pairs, n, best = shipped.value
        for batch in _some_rows(batches):
            row, pair = _links(batch, both)
            found, at = np.unique(pair, return_inverse=True)
            place = np.searchsorted(pairs, found)
            rows = batch.num_rows
            sums = segment_sum(n[place][at], np.searchsorted(row, np.arange(rows + 1)))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(np.bincount(row, best[place][at], rows).astype(np.int64)), pa.array(sums)], ["_row", "n_best", "count_sum"])

    return run


def align(docs: DataFrame, a: str, b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    a: a byte-level tokenizer file, b: a sentence-piece model; every executor has both.
    """
    rows = encode(docs, a, b, id, text)
    counts = stored(pair_counts(rows, a, b), "alignment-counts")
    found = with_counts(rows, counts, a, b)
    joined = rows.select(id, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "_row").join(found, "_row", "left")
    zero = F.lit(0).cast("long")
    return joined.select(id, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
