"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of up to PASSAGE words. Their TF-IDF matrix (document frequencies counted over all
documents) is factored by a distributed randomised SVD; passages and windows of documents are compared by the cosine of their
vectors in the latent space. Windows come in sizes of powers of two, each passage
being compared with those of the least size that holds it, and overlap by three quarters. A candidate is verified by the longest common
subsequence of its words and the passage's, and by an answer check: at least half of the answer's words (those of ``answer`` if the items have
one, else the passage's rarest fifth) are in the matched text. Paraphrases that keep most words in order are found as well as copies.

Candidates come from the latent space alone: the vectors of all windows are multiplied with those of all passages of their size, and pairs whose
cosine reaches CANDIDATE go on. Only windows whose surrounding text has fewer known words than any passage needs have no vector. A candidate is
left out before it is verified if its text has too few words of the answer or of the passage to pass, which loses nothing. The benchmark is taken in blocks of ITEMS_IN_BLOCK passages, each factored on its own. Whatever their number, the
documents are read twice: once for the frequencies of all words of passages, and once for the search, in which a task holds some
documents and goes through the blocks, one of them in its memory at a time.

Rows: null texts and texts without words match nothing; passages of fewer than SHORT words must be found word for word. A null doc_id is searched like
any other and gives a null doc_id. Repeated rows of documents or items give one result for each pair of ids. Empty tables give empty results. Whole
texts are searched, however long. Of equally good matches of a pair of ids the first passage and place counts. Further columns are ignored by ``contaminated`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.shared import segment_sum, stored, text_parts
from statloom.llm.words import U64, word_hashes

PASSAGE, SHORT, LEAST_WINDOW = 64, 8, 16
RANK, OVERSAMPLE, POWER_STEPS = 64, 8, 2
ITEMS_IN_BLOCK = 2000
CANDIDATE, LEAST_LCS, LEAST_ANSWER = 0.4, 0.6, 0.5
#: Windows that are looked at at once, and bytes of text that a task holds while it goes through several blocks; a term in more answers is common.
WINDOWS, HELD_BYTES, COMMON = 4096, 1 << 25, 64
SCHEMA = "item_id long, doc_id long, passage int, start_word long, cosine double, lcs double, answer double"


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by one bit-parallel step for each element of b."""
    where: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of the items: their word hashes, and those of the item's answer (empty: none is given)."""
    for batch in batches:
        for part in text_parts(batch):
            words, at = word_hashes(part.column("text"))
            answers, answer_at = word_hashes(part.column("answer"))
            out = []
            for k, item in enumerate(part.column("item_id").to_pylist()):
                own = words[at[k] : at[k + 1]]
                pieces = max(1, -(-len(own) // PASSAGE))
                for p, piece in enumerate(np.array_split(own, pieces)):
                    if len(piece):
                        out.append((item, p, piece.tobytes(), answers[answer_at[k] : answer_at[k + 1]].tobytes()))
            columns = list(zip(*out)) if out else [()] * 4
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["item_id", "passage", "words", "answer"])


@dataclass
class Vocabulary:
    """Sorted distinct word hashes, with a bit table that rules most other words out first."""

    terms: np.ndarray

    def __post_init__(self) -> None:
        self.bits = max(16, int(np.ceil(np.log2(len(self.terms) + 1))) + 4)
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(self.terms >> U64(64 - self.bits)).astype(np.int64)] = True

    def find(self, words: np.ndarray) -> np.ndarray:
        """Index of each word, -1 if it isn't a term."""
        out = np.full(len(words), -1, np.int64)
        maybe = np.flatnonzero(self.table[(words >> U64(64 - self.bits)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.terms, words[maybe]), len(self.terms) - 1)
            out[maybe] = np.where(self.terms[at] == words[maybe], at, -1)
        return out


def document_frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """In how many documents each term is, and how many documents there are."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shipped.value
        n = len(vocabulary.terms)
        total, rows = np.zeros(n, np.int64), 0
        for batch in batches:
            for part in text_parts(batch):
                words, at = word_hashes(part.column("text"))
                term = vocabulary.find(words)
                row = np.repeat(np.arange(len(at) - 1), np.diff(at))[term >= 0]
                total += np.bincount(np.unique(row * n + term[term >= 0]) % n, minlength=n)
                rows += len(at) - 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *seen], pa.int64()), pa.array([rows, *total[seen]], pa.int64())], ["term", "n"])

    out = np.zeros(len(vocabulary.terms), np.int64)
    rows = 0
    for r in docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r["term"] < 0:
            rows = r["n"]
        else:
            out[r["term"]] = r["n"]
    return out, rows


def randomised_svd(passages: DataFrame, vocabulary: Vocabulary, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The first right singular vectors (terms, rank) of the passages' TF-IDF matrix, of unit rows.

    Each step multiplies a thin matrix by A'A, in a pass over the distributed rows of A whose partial products are added up; orthogonalising it between the steps is
    the driver's part (terms x (rank + OVERSAMPLE) numbers).
    """
    context = passages.sparkSession.sparkContext
    n = len(vocabulary.terms)
    width = min(rank + OVERSAMPLE, n)
    passages = passages.select("words").coalesce(8)

    def times(thin: np.ndarray) -> np.ndarray:
        shipped = context.broadcast((vocabulary, idf, thin))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, idf, thin = shipped.value
            out = np.zeros_like(thin)
            for batch in batches:
                for raw in batch.column("words"):
                    term, times = np.unique(vocabulary.find(np.frombuffer(raw.as_buffer(), U64)), return_counts=True)
                    value = times * idf[term]
                    value /= max(1e-12, np.sqrt((value**2).sum()))
                    out[term] += value[:, None] * (value @ thin[term])[None, :]
            yield pa.RecordBatch.from_arrays([pa.array([out.astype(np.float64).tobytes()], pa.binary())], ["product"])

        total = np.zeros_like(thin)
        for r in passages.mapInArrow(partial, "product binary").toLocalIterator():
            total += np.frombuffer(r["product"], np.float64).reshape(thin.shape)
        shipped.unpersist()
        return total

    basis = np.random.default_rng(5).choice([-1.0, 1.0], (n, width))
    for _ in range(POWER_STEPS + 1):
        basis = np.linalg.qr(times(basis))[0]
    value, vector = np.linalg.eigh(basis.T @ times(basis))
    order = np.argsort(-value)[: min(rank, int((value > 1e-9 * max(value.max(), 1e-300)).sum()))]
    return basis @ vector[:, order]


def _least_order(words: int) -> int:
    """How many words in order a passage of so many words accepts."""
    return int(np.ceil(LEAST_LCS * words - 1e-9)) if words >= SHORT else words


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges from first to last, one after the other, and where each range starts in these."""
    offsets = np.concatenate([[0], np.cumsum(last - first)])
    return np.repeat(first - offsets[:-1], last - first) + np.arange(offsets[-1]), offsets


def _summed_blocks(take, end: int, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``size`` neighbours (fewer at a row's end) of what take gives for places, rows of which start at ``at``; it gives zeros
    for place end. A row of zeros follows the sums. And where each row's sums start."""
    blocks = -(-np.diff(at) // size)
    first = np.concatenate([[0], np.cumsum(blocks)])
    row = np.repeat(np.arange(len(blocks)), blocks)
    begin = at[row] + (np.arange(first[-1]) - first[row]) * size
    last = at[row + 1]
    out = take(np.append(np.minimum(begin, end), end))
    for k in range(1, size):
        out[:-1] += take(np.where(begin + k < last, begin + k, end))
    return out, first


@dataclass
class Index:
    """What the search needs of a block of passages; everything is as large as the block, whatever the documents."""

    vocabulary: Vocabulary
    idf: np.ndarray
    latent: np.ndarray  # terms x rank
    items: np.ndarray
    numbers: np.ndarray
    words: list[np.ndarray]
    answers: list[np.ndarray]

    def __post_init__(self) -> None:
        rows = []
        for words in self.words:
            term, times = np.unique(self.vocabulary.find(words), return_counts=True)
            value = times * self.idf[term]
            rows.append(value @ self.latent[term])
        vectors = np.array(rows)
        vectors /= np.maximum(np.sqrt((vectors**2).sum(1, keepdims=True)), 1e-12)
        size = np.array([len(w) for w in self.words])
        window = np.maximum(LEAST_WINDOW, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(int))
        self.weighted = (self.idf[:, None] * self.latent).astype(np.float32)
        self.need = np.array([_least_order(int(n)) for n in size])  # words in order that each passage accepts
        # words of the answer that a text must have, beside those that no passage has, which are not counted
        self.answer_need = np.array([int(np.ceil(LEAST_ANSWER * len(a) - 1e-9)) - int((self.vocabulary.find(a) < 0).sum()) for a in self.answers])
        self.by_window = {int(w): (np.flatnonzero(window == w), vectors[window == w].T.astype(np.float32)) for w in np.unique(window)}

    def search(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, float, float, float]]:
        """Row, passage, first word, cosine, share of the passage in order, share of the answer, of all that is verified."""
        term = self.vocabulary.find(words)
        known = term >= 0
        found = term[known]  # the words that the latent space knows, and how many there are before each word
        before = np.concatenate([[0], np.cumsum(known)])
        length = np.diff(at)
        answers = self._answer_places(found)
        below = step = 0
        for size, (passages, vectors) in sorted(self.by_window.items()):
            below, step = step, size // 4
            if below:  # a block is made of those of the size before
                lower, first = sums
                sums = _summed_blocks(lower.__getitem__, len(lower) - 1, first, step // below)
            else:
                sums = self._word_blocks(term, at, step)
            count = np.where(length > 0, 1 + np.maximum(0, -(-(length - size) // step)), 0)
            row = np.repeat(np.arange(len(length)), count)
            k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = at[row] + np.minimum(k * step, np.maximum(0, length[row] - size))
            end = np.minimum(start + size, at[row + 1])
            low, high = np.maximum(at[row], start - size // 2), np.minimum(at[row + 1], end + size // 2)
            rich = np.flatnonzero((before[high] - before[low] >= self.need[passages].min()) & (before[end] > before[start]))
            for some in np.split(rich, range(WINDOWS, len(rich), WINDOWS)):
                projected = self._projected(found, before, at, sums, row[some], k[some], start[some], end[some], size)
                norm = np.maximum(np.sqrt(np.square(projected).sum(1, keepdims=True)), 1e-12)
                cosine = projected @ vectors
                i, j = np.nonzero(cosine >= CANDIDATE * norm)
                cosine = cosine[i, j] / norm[i, 0]
                first, last = before[low[some[i]]], before[high[some[i]]]
                stays = self._enough(found, answers, passages[j], first, last)
                for x, p, c in zip(some[i[stays]], passages[j[stays]], cosine[stays].tolist()):
                    if checked := self.verify(p, words[low[x] : high[x]]):
                        yield row[x], p, start[x] - at[row[x]], c, *checked

    def _word_blocks(self, term: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the latent vectors of each block of ``size`` words, counted from where its row starts, with zeros at the end; and the
        first block of each row."""
        none = np.append(self.weighted, np.zeros((1, self.weighted.shape[1]), np.float32), axis=0)
        return _summed_blocks(lambda place: none[np.append(term, -1)[place]], len(term), at, size)

    def _projected(self, found, before, at, sums, row, k, start, end, size) -> np.ndarray:
        """The latent vectors of windows: sums of four blocks, but for those at the end of a row, which needn't begin where a block does."""
        blocks, first = sums
        out = np.zeros((len(row), self.weighted.shape[1]), np.float32)
        whole = (start == at[row] + k * (size // 4)) & (end - start == size)
        begin = first[row[whole]] + k[whole]
        out[whole] = blocks[begin] + blocks[begin + 1] + blocks[begin + 2] + blocks[begin + 3]
        other = np.flatnonzero(~whole)
        places, offsets = _ranges(before[start[other]], before[end[other]])
        out[other] = segment_sum(self.weighted[found[places]], offsets)
        return out

    @cached_property
    def answer_terms(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Passages by term of their answer, how often the answer has it, and where each term's begin; and which terms are so COMMON that any
        of their places counts for every passage. Each executor makes its own."""
        term = [self.vocabulary.find(a) for a in self.answers]
        passage = np.repeat(np.arange(len(term)), [len(t) for t in term])
        term = np.concatenate(term) if term else np.zeros(0, np.int64)
        passage, term = passage[term >= 0], term[term >= 0]
        pair, times = np.unique(term * max(1, len(self.answers)) + passage, return_counts=True)
        term, passage = pair // max(1, len(self.answers)), pair % max(1, len(self.answers))
        begin = np.searchsorted(term, np.arange(len(self.vocabulary.terms) + 1))
        common = np.diff(begin) > COMMON
        most = np.zeros(len(common), np.int64)
        np.maximum.at(most, term, times)
        return passage, times, begin, np.where(common, most, 0)

    def _answer_places(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of answer words in the known words found, as sorted numbers (passage, place) with running sums of how often the
        answer has them; and running sums of the common terms' places."""
        passage, times, begin, common = self.answer_terms
        degree = np.where(common[found] > 0, 0, begin[found + 1] - begin[found])
        at, _ = _ranges(begin[found], begin[found] + degree)
        key = passage[at] * (len(found) + 1) + np.repeat(np.arange(len(found)), degree)
        order = np.argsort(key)
        return key[order], np.concatenate([[0], np.cumsum(times[at][order])]), np.concatenate([[0], np.cumsum(common[found])])

    def _enough(self, found: np.ndarray, answers: tuple, passage: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which of the pairs of a passage and a text, a range of the known words found, have as many words of both as they need."""
        key, upto, common = answers
        own = passage * (len(found) + 1)
        total = upto[np.searchsorted(key, own + last)] - upto[np.searchsorted(key, own + first)] + common[last] - common[first]
        stays = np.flatnonzero(total >= self.answer_need[passage])
        enough = np.zeros(len(stays), bool)
        for k in range(0, len(stays), WINDOWS):
            some = stays[k : k + WINDOWS]
            at, offsets = _ranges(first[some], last[some])
            wanted = np.repeat(passage[some], np.diff(offsets)) * len(self.vocabulary.terms) + found[at]
            place = np.minimum(np.searchsorted(self.members, wanted), len(self.members) - 1)
            enough[k : k + WINDOWS] = segment_sum((self.members[place] == wanted).astype(np.int64), offsets) >= self.need[passage[some]]
        return stays[enough]

    @cached_property
    def members(self) -> np.ndarray:
        """The words of all passages as sorted numbers (passage, term)."""
        return np.unique(np.concatenate([p * len(self.vocabulary.terms) + self.vocabulary.find(w) for p, w in enumerate(self.words)]))

    def verify(self, passage: int, text: np.ndarray) -> tuple[float, float] | None:
        words, answer = self.words[passage], self.answers[passage]
        share = float(np.isin(answer, text).mean()) if len(answer) else 1.0
        if share < LEAST_ANSWER:
            return None
        order = lcs(words, text)
        return (order / len(words), share) if order >= self.need[passage] else None


def _indices(passages: DataFrame, docs: DataFrame) -> list[Broadcast]:
    """The index of each block of passages, broadcast. The driver holds one of them, and the distinct words of all, at a time."""
    blocks = -(-passages.count() // ITEMS_IN_BLOCK)
    passages = passages.withColumn("part", F.pmod(F.xxhash64("item_id", "passage"), F.lit(max(1, blocks))))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(batch.column("words").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(raw, U64)).view(np.int64))], ["term"])

    terms = passages.select("words").mapInArrow(distinct, "term long").distinct().toArrow()["term"].to_numpy()
    if not len(terms):
        return []
    vocabulary = Vocabulary(np.sort(terms.view(U64)))
    frequency, total = document_frequencies(docs, vocabulary)
    all_idf = np.log((total + 2) / (frequency + 1))
    found = []
    for b in range(blocks):
        block = passages.where(F.col("part") == b) if blocks > 1 else passages
        rows = block.orderBy("item_id", "passage", "words").toArrow().to_pylist()
        if rows:
            index = _index(block, rows, vocabulary, all_idf)
            found.append(docs.sparkSession.sparkContext.broadcast(index))
    return found


def _index(block: DataFrame, rows: list[dict], vocabulary: Vocabulary, idf: np.ndarray) -> Index:
    words = [np.frombuffer(r["words"], U64) for r in rows]
    own = Vocabulary(np.unique(np.concatenate(words)))
    idf = idf[vocabulary.find(own.terms)]
    latent = randomised_svd(block, own, idf)
    answers = []
    for r, w in zip(rows, words):
        given = np.frombuffer(r["answer"], U64)
        if not len(given):
            some = np.unique(w)
            rare = idf[own.find(some)]
            given = some[np.lexsort([some, -rare])][: -(-len(some) // 5)]
        answers.append(given)
    return Index(own, idf, latent, np.array([r["item_id"] for r in rows]), np.array([r["passage"] for r in rows]), words, answers)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """item_id, doc_id and the best verified match of each such pair.

    docs: doc_id, text. benchmark: item_id, text and, if it has one, answer; items with a null id are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit("")
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text", answer.alias("answer"))
    passages = stored(items.mapInArrow(_passages, "item_id long, passage int, words binary, answer binary"), "passages")
    found = _search(docs, _indices(passages, docs))
    best = F.max_by(F.struct("passage", "start_word", "cosine", "lcs", "answer"), F.struct("lcs", "cosine", -F.col("passage"), -F.col("start_word"))).alias("m")
    return found.groupBy("item_id", "doc_id").agg(best).select("item_id", "doc_id", "m.*")


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """doc_id, words and where each row's words start, of HELD_BYTES of text (or one row more) at a time."""
    ids, words, sizes, held = [], [], [], 0
    for batch in batches:
        for part in text_parts(batch):
            w, at = word_hashes(part.column("text"))
            ids += part.column("doc_id").to_pylist()
            words.append(w)
            sizes.append(np.diff(at))
            held += part.nbytes
            if held >= HELD_BYTES:
                yield ids, np.concatenate(words), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
                ids, words, sizes, held = [], [], [], 0
    if ids:
        yield ids, np.concatenate(words), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _search(docs: DataFrame, indices: list[Broadcast]) -> DataFrame:
    many = len(indices) > 1

    def matches(index: Index, ids: list, words: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        best: dict[tuple[int, int], tuple] = {}
        for row, p, start, cosine, order, share in index.search(words, at):
            key = (row, int(index.items[p]))
            found = (order, cosine, -int(index.numbers[p]), -start, share)
            if key not in best or found > best[key]:
                best[key] = found
        out = [(item, ids[row], -number, -start, cosine, order, share) for (row, item), (order, cosine, number, start, share) in best.items()]
        columns = list(zip(*out)) if out else [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["item_id", "doc_id", "passage", "start_word", "cosine", "lcs", "answer"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if many:
            for ids, words, at in _held(batches):
                for index in indices:
                    # read from the executor's copy of the broadcast each time, so that no worker keeps more than one
                    yield matches(index.load_from_path(index._path), ids, words, at)
            return
        for batch in batches if indices else ():
            for part in text_parts(batch):
                yield matches(indices[0].value, part.column("doc_id").to_pylist(), *word_hashes(part.column("text")))

    return docs.mapInArrow(search, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item; documents with a null doc_id stay."""
    found = contaminated(docs, benchmark).select("doc_id").where("doc_id is not null").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
