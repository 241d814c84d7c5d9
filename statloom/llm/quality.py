"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates (FTRL-proximal).

A text is cut into words (runs of letters and digits) and marks (runs of one punctuation character). Hashed features are the
word 1- and 2-grams, and the 1-, 2- and 3-grams of the words' shapes: case pattern, the mark itself, or "the same word as
before". A document's sparse vector holds counts divided by the number of tokens; its score is the logistic of the sparse dot
product with the weights, over the whole text.

Rows: null and empty texts get the score of the bias alone. Labels other than 0 and 1, null labels and labels of absent documents
teach nothing; a document with both labels counts once for each, and repeated label rows, or rows of one doc_id, count once (the greatest text).
Empty labels or tables give the score 0.5 or no rows. Ties cannot matter, as examples come in the order of a hash. Repeated rows are scored alike. Further
columns are kept by ``score`` (its own column replaces one of the same name).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.shared import hashed_below, packed, segment_sum, text_parts, unpacked, utf8
from statloom.llm.words import U64, mix, span_hashes

BITS = 18
#: Counts divided by tokens are multiplied by this, so that a learning rate near 1 suits them.
SCALE = 16.0
_OTHER, _LOWER, _UPPER, _DIGIT, _MARK, _SPACE = range(6)
_CLASS = np.array([_SPACE if b <= 32 or b == 127 else _DIGIT if chr(b).isdigit() else _UPPER if chr(b).isupper() else _LOWER if chr(b).islower() else _MARK for b in range(128)] + [_OTHER] * 128, np.uint8)
_TO_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and shape hashes of a text column's tokens, and where each row's tokens start."""
    raw, offsets = utf8(column)
    if not len(raw):
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    kind = _CLASS[raw]
    # one group for all that makes up words, one for each punctuation character, 0 for space
    group = np.where(kind == _SPACE, 0, np.where(kind == _MARK, raw.astype(np.int16) + 2, 1))
    begins = group > 0
    begins[1:] &= group[1:] != group[:-1]
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = group[offsets[:-1][offsets[:-1] < offsets[1:]]] > 0
    stops = group > 0
    stops[:-1] &= group[1:] != group[:-1]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    stops[last] = group[last] > 0
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    at = np.searchsorted(starts, offsets)
    lexical = span_hashes(_TO_LOWER[raw], starts, ends)
    upper = np.concatenate([[0], np.cumsum(kind == _UPPER)])
    digit = np.concatenate([[0], np.cumsum(kind == _DIGIT)])
    size, ups, digits = ends - starts, upper[ends] - upper[starts], digit[ends] - digit[starts]
    first_up = kind[starts] == _UPPER
    word = group[starts] == 1
    case = np.where(ups == 0, 0, np.where((ups == 1) & first_up, 1, np.where(ups == size - digits, 2, 3)))
    number = np.where(digits == 0, 0, np.where(digits == size, 2, 1))
    shape = np.where(word, case * 3 + number, 16 + group[starts] * 4 + np.minimum(size, 3)).astype(U64)
    # a word that repeats the last word of the same text
    index = np.flatnonzero(word)
    row = np.searchsorted(at, index, side="right")
    again = np.flatnonzero((lexical[index[1:]] == lexical[index[:-1]]) & (row[1:] == row[:-1])) + 1 if len(index) > 1 else np.zeros(0, int)
    shape[index[again]] = 15
    return lexical, mix(shape + U64(1)), at


def features(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket of every token's n-gram of each kind (n-grams that begin before their text are shortened), and row offsets."""
    words, shapes, at = tokens(column)
    position = np.arange(len(words)) - np.repeat(at[:-1], np.diff(at))

    def gram(of: np.ndarray, n: int, salt: int) -> np.ndarray:
        h = of + U64(salt)
        for k in range(1, n):
            past = np.zeros_like(of)
            past[k:] = of[:-k] if k else of
            h = h * U64(0x9E3779B97F4A7C15) + np.where(position >= k, past, U64(0))
        return (mix(h) >> U64(64 - BITS)).astype(np.int32)

    return [gram(words, 1, 1), gram(words, 2, 2), gram(shapes, 1, 3), gram(shapes, 2, 4), gram(shapes, 3, 5)], at


@dataclass
class QualityModel:
    bias: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))

    def score(self, column: pa.Array) -> np.ndarray:
        grams, at = features(column)
        total = segment_sum(sum(self.weights[g] for g in grams), at).astype(np.float64)
        z = self.bias + SCALE * total / np.maximum(np.diff(at), 1)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_parts(batch):
            grams, at = features(part.column("text"))
            index, value = [], []
            for a, b in zip(at[:-1], at[1:]):
                found, n = np.unique(np.concatenate([g[a:b] for g in grams]), return_counts=True)
                index.append(packed(np.diff(found, prepend=np.int32(0))))
                value.append(packed((n * (SCALE / max(1, b - a))).astype(np.float32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(index, pa.binary()), pa.array(value, pa.binary())], ["doc_id", "label", "index", "value"])


def ftrl(index: list[np.ndarray], value: list[np.ndarray], label: np.ndarray, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.002, l2: float = 0.05) -> QualityModel:
    """FTRL-proximal over the examples in the given order; the bias has no penalty."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    end = 1 << BITS

    def weight(i: np.ndarray) -> np.ndarray:
        zi, penal = z[i], np.where(i == end, 0.0, 1.0)
        w = -(zi - np.sign(zi) * l1 * penal) / ((beta + np.sqrt(n[i])) / alpha + l2 * penal)
        return np.where(np.abs(zi) <= l1 * penal, 0.0, w)

    for _ in range(epochs):
        for i, x, y in zip(index, value, label):
            i, x = np.append(i, end), np.append(x, 1.0)
            w = weight(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = weight(np.arange(end + 1))
    return QualityModel(float(w[end]), w[:end].astype(np.float32))


def sampled(docs: DataFrame, labels: DataFrame, n: int, max_rows: int) -> DataFrame:
    """doc_id, label and text of about max_rows of the n labels(doc_id, label), taken by a hash of doc_id; repeated rows come once,
    so that the sample is bounded whatever doc_id holds most rows."""
    some = labels.where(hashed_below(F.lit(min(1.0, max_rows / n)), F.col("doc_id").cast("string"), F.lit("quality"))).distinct()
    # about max_rows rows of two numbers, which bounds what is broadcast
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.max("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 4000) -> QualityModel:
    """A model of labels(doc_id, quality) over docs(doc_id, text).

    max_rows bounds the sample that is learned from: about that many labelled documents, taken by a hash of doc_id.
    """
    labels = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("label"))
    n = labels.agg(F.approx_count_distinct("doc_id", 0.02)).first()[0]
    if not n:
        return QualityModel()
    sample = sampled(docs, labels, n, max_rows)
    got = sample.mapInArrow(_vectors, "doc_id long, label int, index binary, value binary").toArrow()
    label = got["label"].to_numpy()
    key = mix(got["doc_id"].to_numpy().astype(np.int64).view(U64))
    order = np.lexsort([label, key])
    index = [np.cumsum(unpacked(x, np.int32), dtype=np.int32) for x in got["index"]]
    value = [unpacked(x, np.float32) for x in got["value"]]
    model = ftrl([index[k] for k in order], [value[k] for k in order], label[order])
    del got, index, value
    pa.default_memory_pool().release_unused()
    return model


def score(docs: DataFrame, model: QualityModel, column: str = "score") -> DataFrame:
    """docs with the model's score of every whole text."""
    keep = [c for c in docs.columns if c != column]
    schema = docs.select(*keep).schema.add(column, "double")
    # the weights are 2 ** BITS floats whatever the input
    shipped = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = QualityModel(*shipped.value)
        for batch in batches:
            for part in text_parts(batch):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(here.score(part.column("text")), pa.float64())], [*keep, column])

    return docs.select(*keep).mapInArrow(scored, schema)
