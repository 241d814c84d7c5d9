"""Language ID by hierarchical discrimination: the language family first, then one-versus-one linear SVMs within it.

Features are hashed byte 2-, 3- and 4-grams of the lower-cased letters of the whole text, every other run a single space; a
document's vector holds their shares. All SVMs are linear, so scoring is one table look-up per n-gram and a mean per document.

Rows: null text, or a text without a letter: ``und`` with score 0, and so is all if no language was learned. Empty tables give empty results. Repeated rows are scored
alike, and rows of one doc_id and language teach once. Ties of wins go to the larger sum of margins, then the first label. Further columns are kept by
``identify`` (names of the result replace columns of the same name). Long texts are summed in strips.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.shared import hashed_below, packed, segment_sum, text_parts, unpacked, utf8

#: Families by ISO 639-1 code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

BUCKETS = 4096
#: Weights that a scoring pass gathers at once.
STRIP = 1 << 22
GRAMS = (2, 3, 4)
UNKNOWN = "und"
_SPACE = 32
_LETTERS = np.array([b if b >= 128 or chr(b).isalpha() else _SPACE for b in range(256)], np.uint8)


def gram_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams (BUCKETS: none, it crosses two rows or is blank), their row offsets, and which rows have a letter."""
    raw, offsets = utf8(pc.utf8_lower(pc.fill_null(column, "")))
    raw = _LETTERS[raw]
    blank = raw == _SPACE
    keep = np.ones(len(raw), bool)  # the first of each run of spaces
    keep[1:] = ~(blank[1:] & blank[:-1])
    total = np.concatenate([[0], np.cumsum(keep)])
    raw, offsets = raw[keep], total[offsets]
    n = len(raw)
    wide = np.concatenate([raw, np.zeros(max(GRAMS), np.uint8)]).astype(np.uint32)
    letters = segment_sum((raw != _SPACE).astype(np.int64), offsets) > 0
    out = np.full((len(GRAMS), n), BUCKETS, np.int32)
    h = wide[:n].copy()
    for k in range(1, max(GRAMS)):
        h = h * np.uint32(257) + wide[k : k + n]
        if k + 1 in GRAMS:
            row = out[GRAMS.index(k + 1)]
            row[:] = ((h * np.uint32(2654435761) + np.uint32(k * 0x1F3779B1)) >> np.uint32(20)) % np.uint32(BUCKETS)
            for back in range(1, k + 1):
                row[np.maximum(offsets[1:] - back, offsets[:-1])[offsets[1:] > offsets[:-1]]] = BUCKETS
    return out, offsets, letters


def gram_shares(column: pa.Array) -> np.ndarray:
    """Each row's shares of its n-grams in the buckets."""
    grams, offsets, _ = gram_buckets(column)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = np.zeros(((len(offsets) - 1) * (BUCKETS + 1)), np.float32)
    for g in grams:
        out += np.bincount(row * (BUCKETS + 1) + g, minlength=len(out)).astype(np.float32)
    out = out.reshape(-1, BUCKETS + 1)[:, :BUCKETS]
    return out / np.maximum(out.sum(1, keepdims=True), 1)


def fit_svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 10) -> np.ndarray:
    """Weights (the last is the bias) of an L2-regularised squared-hinge SVM of some rows of x, by dual coordinate descent; y is 1 or -1."""
    n, d = len(rows), x.shape[1]
    w, bias, dual = np.zeros(d, np.float32), 0.0, np.zeros(n)
    share = {s: n / (2 * max(1, (y == s).sum())) for s in (1, -1)}
    diagonal = np.array([1 / (2 * cost * share[s]) for s in y])
    norm = np.array([float(x[r] @ x[r]) for r in rows]) + 1 + diagonal
    order = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(n):
            v = x[rows[i]]
            slope = y[i] * (float(v @ w) + bias) - 1 + diagonal[i] * dual[i]
            new = max(dual[i] - slope / norm[i], 0.0)
            if step := (new - dual[i]) * y[i]:
                w += np.float32(step) * v
                bias += step
                dual[i] = new
                moved = max(moved, abs(step))
        if moved < 3e-3:
            break
    return np.append(w, bias)


@dataclass
class LanguageModel:
    """pairs: for each SVM, the two labels it separates (the first wins at a positive margin) and whether they are families."""

    langs: list[str]
    pairs: list[tuple[str, str, bool]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS + 1, 0), np.float32))
    biases: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def family(self, lang: str) -> str:
        return FAMILY_OF.get(lang.lower().split("-")[0], lang)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Languages and scores of a text column: the product of the logistic margins of the decisions on the way."""
        grams, offsets, letters = gram_buckets(column)
        if not self.langs:
            return [UNKNOWN] * len(letters), np.zeros(len(letters))
        total, count = np.zeros((len(letters), len(self.pairs)), np.float64), np.zeros(len(letters))
        strip = max(4096, STRIP // max(1, len(self.pairs)))
        for g in grams:
            for k in range(0, len(g), strip):
                inside = np.clip(offsets - k, 0, min(strip, len(g) - k))
                total += segment_sum(self.weights[g[k : k + strip]], inside)
            count += segment_sum((g < BUCKETS).astype(np.int64), offsets)
        margin = total / np.maximum(count, 1)[:, None] + self.biases
        families = sorted({self.family(x) for x in self.langs})
        found, score = np.full(len(letters), UNKNOWN, object), np.zeros(len(letters))
        first, sure = self._winner(families, margin, True)
        for k, family in enumerate(families):
            rows = np.flatnonzero(letters & (first == k))
            langs = [x for x in self.langs if self.family(x) == family]
            second, then = self._winner(langs, margin[rows], False)
            found[rows], score[rows] = np.array(langs, object)[second], sure[rows] * then
        return list(found), score

    def _winner(self, labels: list[str], margin: np.ndarray, families: bool) -> tuple[np.ndarray, np.ndarray]:
        """The label with most one-versus-one wins (ties: the larger sum of margins), and its least sure decision."""
        wins, least = np.zeros((len(margin), len(labels))), np.ones((len(margin), len(labels)))
        for k, (a, b, of) in enumerate(self.pairs):
            if of == families and a in labels and b in labels:
                m, i, j = margin[:, k], labels.index(a), labels.index(b)
                sure = 1 / (1 + np.exp(-2 * np.clip(m, -30, 30)))
                wins[:, i] += (m > 0) + np.tanh(m) / (4 * len(labels))
                wins[:, j] += (m <= 0) - np.tanh(m) / (4 * len(labels))
                least[:, i] = np.minimum(least[:, i], sure)
                least[:, j] = np.minimum(least[:, j], 1 - sure)
        best = wins.argmax(1)
        return best, least[np.arange(len(margin)), best]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The labelled texts and, so that short texts are learned too, one window of 1 to 24 words of each."""
    for batch in batches:
        for part in text_parts(batch):
            langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
            for k, text in enumerate(texts.copy()):
                words = text.split()
                if len(words) > 24:
                    size = (1, 2, 4, 8, 16, 24)[len(words) % 6]
                    at = (len(words) * 7919) % (len(words) - size)
                    texts.append(" ".join(words[at : at + size]))
                    langs.append(langs[k])
            shares = gram_shares(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([packed(x) for x in shares], pa.binary())], ["lang", "shares"])


def sampled(docs: DataFrame, counts: dict[str, int], max_rows: int) -> DataFrame:
    """lang and text of about max_rows documents, as many of each language of counts, taken by a hash of doc_id (of the text where that is
    null); repeated rows come once, so that the sample is bounded whatever key holds most rows."""
    each = max(1, max_rows // len(counts))
    key = F.coalesce(F.col("doc_id").cast("string"), "text")
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, each / n)) for lang, n in counts.items()], "lang string, share double")
    some = docs.select("lang", "text", key.alias("key")).join(F.broadcast(shares), "lang").where(hashed_below(F.col("share"), F.col("key"), F.lit("language")))
    return some.groupBy("lang", "key").agg(F.max("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, max_rows: int = 1200) -> LanguageModel:
    """A model of the languages in docs(doc_id, text, lang); rows with null text or lang teach nothing.

    max_rows bounds the sample that the SVMs see: about max_rows documents, as many of each language, taken by a hash of doc_id.
    """
    docs = docs.where("lang is not null and text is not null")
    documents = F.approx_count_distinct(F.coalesce(F.col("doc_id").cast("string"), F.col("text")), 0.02)
    # a row for each language
    counts = {r["lang"]: max(1, r["n"]) for r in docs.groupBy("lang").agg(documents.alias("n")).collect()}
    model = LanguageModel(sorted(counts))
    if len(counts) < 2:
        return model
    sample = sampled(docs, counts, max_rows)
    got = sample.mapInArrow(_examples, "lang string, shares binary").toArrow()
    lang = np.array(got["lang"].to_pylist(), object)
    x = np.empty((len(lang), BUCKETS), np.float32)
    for k, raw in enumerate(got["shares"]):
        x[k] = unpacked(raw, np.float32)
    del got
    pa.default_memory_pool().release_unused()
    order = np.lexsort([x.argmax(1), x.max(1), lang.astype(str)])  # the same whatever the partitions
    scale = np.float32(1 / max(1e-9, np.mean([np.sqrt(v @ v) for v in x]) if len(x) else 1.0))
    x *= scale
    of = np.array([model.family(v) for v in lang], object)
    tasks = [(a, b, True, of) for a, b in combinations(sorted(set(of)), 2)]
    tasks += [(a, b, False, lang) for a, b in combinations(model.langs, 2) if model.family(a) == model.family(b)]
    columns, biases = [], []
    for a, b, families, y in tasks:
        rows = order[(y[order] == a) | (y[order] == b)]
        if len(set(y[rows])) < 2:
            continue
        w = fit_svm(x, rows, np.where(y[rows] == a, 1, -1))
        columns.append(np.append(w[:-1] * scale, 0).astype(np.float32))
        biases.append(w[-1])
        model.pairs.append((a, b, families))
    if columns:
        model.weights, model.biases = np.ascontiguousarray(np.stack(columns, 1)), np.array(biases)
    return model


def identify(docs: DataFrame, model: LanguageModel, columns: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and the score of every whole text, in columns of the given names."""
    keep = [c for c in docs.columns if c not in columns]
    schema = docs.select(*keep).schema.add(columns[0], "string").add(columns[1], "double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch):
                lang, score = model.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, *columns])

    return docs.select(*keep).mapInArrow(predict, schema)
