"""Packing of tokenised documents into sequences along a Hilbert curve.

Each document's words are hashed into a signed vector, damped and scaled to length 1, and projected to DIMENSIONS numbers; their
place on a Hilbert curve is the sort key, so documents of like content are neighbours. The curve is cut into ranges, one per
partition, and each range is packed in order as one stream of token ids, cut at every full sequence. What remains at a range's
end is cut into lengths that are powers of two, which need no padding either.

A document's tokens are the ids of its whole text and an end id. Null text: empty, the end id alone. Copies share a place on the
curve and are spread by a hash of doc_id, so a large group of them is cut like any other run of the curve. Repeated rows (of one doc_id, or
null, and one text) are packed each; those of a batch go to a task as one row and their number. An empty table gives no rows. Further
columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from codecs import charmap_decode
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.shared import partitions, repeats, text_parts, utf8
from statloom.llm.words import U64, mix, word_hashes

VECTOR, DIMENSIONS, BITS = 256, 4, 12
_TIE = 63 - DIMENSIONS * BITS
_PROJECT = np.random.default_rng(11).standard_normal((VECTOR, DIMENSIONS))
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def document_points(column: pa.Array) -> np.ndarray:
    """Each text's place in the projected space, as integers of BITS bits."""
    words, at = word_hashes(column)
    n = len(at) - 1
    cell = np.repeat(np.arange(n), np.diff(at)) * VECTOR + (words >> U64(56)).astype(np.int64)
    v = np.bincount(cell, weights=1.0 - 2.0 * (words & U64(1)).astype(np.float64), minlength=n * VECTOR).reshape(n, VECTOR)
    v = np.sign(v) * np.sqrt(np.abs(v))
    v /= np.maximum(np.sqrt((v**2).sum(1, keepdims=True)), 1e-12)
    spread = 1 / (1 + np.exp(-1.702 * (v @ _PROJECT)))
    return np.minimum(spread * (1 << BITS), (1 << BITS) - 1).astype(np.int64)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions of points (n, d) on the Hilbert curve of the grid with 2 ** bits cells a side."""
    axis = [points[:, k].copy() for k in range(points.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of the cells, from the coarsest on
        for k in range(len(axis)):
            set_ = (axis[k] & q) > 0
            swap = np.where(set_, 0, (axis[0] ^ axis[k]) & (q - 1))
            axis[0] ^= np.where(set_, q - 1, swap)
            axis[k] ^= swap
        q >>= 1
    for k in range(1, len(axis)):  # Gray code
        axis[k] ^= axis[k - 1]
    flip = np.zeros_like(axis[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((axis[-1] & q) > 0, q - 1, 0)
        q >>= 1
    out = np.zeros_like(axis[0])
    for bit in range(bits - 1, -1, -1):
        for a in axis:
            out = out << 1 | ((a ^ flip) >> bit & 1)
    return out


def curve_keys(column: pa.Array, doc_id: pa.Array) -> np.ndarray:
    """Sort keys of documents: the place on the curve, then a hash of doc_id."""
    tie = mix(doc_id.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).view(U64)) >> U64(64 - _TIE)
    return hilbert(document_points(column)) << _TIE | tie.astype(np.int64)


class TokenIds:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes, exactly as the tokenizer's encode gives them.

    Where the tokenizer never joins what white space parts, a text's ids are those of its pieces between blanks and line ends, which
    are kept in a bounded dictionary. Pieces of Latin-1 letters with marks at the end go to the tokenizer's own merge model alone,
    all at once; others go through the whole tokenizer. Both ways are tried on PROBES when a file is loaded; a tokenizer of another kind
    encodes whole texts.
    """

    KEEP = 250_000  # pieces of either generation; what is used again moves to the younger
    MARKS = '.,!?;:"#$%&*|()'
    PROBES = ("a b", " two  blanks ", "One\nTwo\r\nThree\tFour", "don't I'll 12 345 6.7", "Éa ß çÀ, Ñandú! naïve?", "x( y) (z) a&b &amp; \"q\"", "日本語 テスト 한국", "The quick brown fox JUMPS; over: the|dog #1 50%")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks of an executor share its cores already
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = getattr(self.whole.model, "end_of_word_suffix", None) or ""
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.plain = bool(suffix)
        if suffix:
            self.ends[[k for v, k in vocabulary.items() if v.endswith(suffix)]] = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabet: these stand for themselves
        other = [b for b in range(256) if b not in printable]
        codes = {b: 256 + k for k, b in enumerate(other) if b != 32}
        self.byte_level = "".join(chr(codes.get(b, b)) for b in range(256))
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        want = self._whole(list(self.PROBES))
        self.pieces = True
        if self.plain and self.encode(list(self.PROBES)) != want:
            self.plain, self.young, self.marks = False, {"": b""}, {"": b""}
        self.pieces = self.encode(list(self.PROBES)) == want

    def _whole(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(pieces, add_special_tokens=False)] if pieces else []

    def _learn(self, pieces: list[str]) -> None:
        bare = [piece.rstrip(self.MARKS) for piece in pieces]
        fine = [self.plain and word.isalpha() and (word.isascii() or max(word) < "\u0100") for word in bare]
        odd = [piece for piece, own in zip(pieces, fine) if not own]
        names, words = list(compress(pieces, fine)), list(compress(bare, fine))
        tails = [name[len(word) :] for name, word in zip(names, words)]
        self.young.update(zip(odd, self._whole(odd)))
        if len(self.marks) > 10_000:
            self.marks = {"": b""}
        new = [m for m in set(tails) if m not in self.marks]
        self.marks.update(zip(new, self._whole(new)))
        if not names:
            return
        words = "\n".join(words).lower().split("\n")
        different = list(dict.fromkeys(words))  # a word is met with several marks, and in either case
        lines = [charmap_decode(" ".join(different[k : k + 512]).encode(), "strict", self.byte_level)[0] for k in range(0, len(different), 512)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.merges.encode_batch_fast(lines, add_special_tokens=False)])
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(cuts) != len(different):  # a word whose end is no token of its own
            self.young.update(zip(names, self._whole(names)))
            return
        raw, marks = ids.tobytes(), self.marks
        found = {word: raw[a:b] for word, a, b in zip(different, [0, *cuts], cuts)}
        self.young.update((name, found[word] + marks[tail]) for name, word, tail in zip(names, words, tails))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.pieces:
            return self._whole(texts)
        cut = [t.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ") for t in texts]
        need: set[str] = set().union(*cut)
        if len(self.young) > self.KEEP:
            self.old, self.young = self.young, {"": b""}
        new = need.difference(self.young)
        if new and self.old:
            again = self.old.keys() & new  # walks through new, where an intersection with a dict walks through the dict
            self.young.update((p, self.old[p]) for p in again)
            new -= again
        if new:
            self._learn(list(new))
        find = self.young.__getitem__
        return [b"".join(map(find, pieces)) for pieces in cut]


_tokenizers: dict[str, TokenIds] = {}


def token_ids(path: str) -> TokenIds:
    """One for each worker process and path: its dictionary serves all tasks of the worker."""
    if path not in _tokenizers:
        _tokenizers[path] = TokenIds(path)
    return _tokenizers[path]


def _cut(pieces: list[tuple], sequence: int, total: int) -> Iterator[tuple]:
    """Pieces (doc_id, start, ids, doc_tokens) of one stream, whole if it fills a sequence, else over lengths that are powers of two."""
    lengths = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    at, left = 0, lengths[0]
    for doc_id, start, ids, tokens in pieces:
        n, done = len(ids) // 4, 0
        while done < n:
            take = min(left, n - done)
            yield doc_id, start + done, take, zlib.crc32(ids[4 * done : 4 * (done + take)]), tokens, sequence, lengths[at] - left
            done += take
            left -= take
            if not left:
                at, sequence = at + 1, sequence + 1
                left = lengths[at] if at < len(lengths) else 0


def pack(docs: DataFrame, path: str, end_id: int = 2, size: int = 4096, sample: int = 20000) -> DataFrame:
    """Pieces of the documents of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    path: a tokenizer file that every executor has. size: ids in a sequence, a power of two. sample: about how many rows, taken at random,
    set the ends of the ranges, which have about as much text each; these only balance the partitions.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    spark = docs.sparkSession
    n = partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    some = docs.where(F.rand(5) < sample / max(1, docs.count()))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch):
                yield pa.RecordBatch.from_arrays([pa.array(curve_keys(part.column("text"), part.column("doc_id"))), pa.array(np.diff(utf8(part.column("text"))[1]) + 64)], ["key", "bytes"])

    seen = some.mapInArrow(keys, "key long, bytes long").toArrow()
    order = np.argsort(seen["key"].to_numpy())
    upto = np.cumsum(seen["bytes"].to_numpy()[order])
    ends = seen["key"].to_numpy()[order][np.searchsorted(upto, np.arange(1, n) * (upto[-1] / n))] if len(order) else np.zeros(0, np.int64)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch):
                key = curve_keys(part.column("text"), part.column("doc_id"))
                ids = part.column("doc_id")
                kept, many = repeats(part, [key, ids.fill_null(-1).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)])
                key, part = key[kept], part.take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(many), pa.array(key), pa.array(np.searchsorted(ends, key, side="right").astype(np.int32))], ["doc_id", "text", "many", "key", "range"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, last = token_ids(path), np.array([end_id], "<u4").tobytes()
        here, sequence, filled, open_ = -1, 0, 0, []
        out: list[tuple] = []

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) if found else [()] * 7
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            for part in text_parts(batch):
                encoded = ids_of.encode([t or "" for t in part.column("text").to_pylist()])
                rows = zip(*(part.column(c).to_pylist() for c in ("doc_id", "range", "many")), encoded)
                for doc_id, range_, ids in ((d, r, i) for d, r, many, i in rows for _ in range(many)):
                    if range_ != here:
                        if filled:
                            out += _cut(open_, sequence, filled)
                        here, sequence, filled, open_ = range_, range_ << 40, 0, []
                    ids = ids + last
                    tokens, start = len(ids) // 4, 0
                    while start < tokens:
                        take = min(size - filled, tokens - start)
                        open_.append((doc_id, start, ids[4 * start : 4 * (start + take)], tokens))
                        start, filled = start + take, filled + take
                        if filled == size:
                            out += _cut(open_, sequence, size)
                            sequence, filled, open_ = sequence + 1, 0, []
                    if len(out) > 1 << 16:
                        yield batch_of(out)
                        out = []
                yield batch_of(out)
                out = []
        if filled:
            yield batch_of(list(_cut(open_, sequence, filled)))

    ranged = docs.mapInArrow(keyed, "doc_id long, text string, many long, key long, range int").repartitionById(n, F.col("range"))
    return ranged.sortWithinPartitions("key", "doc_id", "text").select("doc_id", "text", "many", "range").mapInArrow(packed, SCHEMA)
