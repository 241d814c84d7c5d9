"""URL filter: host and path rules first, then a character language-model ratio.

Two smoothed variable-order Markov models (orders 0 to ORDER, interpolated by Witten and Bell's method) are trained on accepted
and on rejected URLs; a URL is allowed if the difference of its log-likelihoods, divided by its length, reaches a threshold that
was calibrated on URLs held out of the training. All labelled URLs count: n-grams are counted in each task by their places in the models'
tables, and summed in Spark by place. The tables have a fixed number of places (PLACES), whatever the number of URLs: 33 MB for both models,
broadcast once, and 2 million rows at most at a time on the driver. n-grams that share a place share its counts.

Rules: (host, path) pairs written ``host/path``. A rule fits its host and all its subdomains, if the URL's path starts with the
rule's; of the rules that fit, the longest decides. Host: from after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or the end. A null URL, or one without ``://``, has an empty host and path.

Rows: such a URL fits no rule; its ratio is that of its text, an empty text's being 0. Without accepted or rejected URLs the
ratio is 0 and all is allowed. Repeated rows are judged alike. Further columns are kept (``host path rule ratio verdict`` are replaced).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.shared import segment_sum, stored, text_parts, utf8
from statloom.llm.words import U64, mix

#: The highest order; bits of a place in a small model's tables, and of each order in a fitted model's.
ORDER, BITS, PLACES = 5, 16, (12, 16, 18, 18, 19, 19)
#: n-grams that a task holds before it hands on their counts; the width of a bin of ratios.
HELD, BIN = 1 << 20, 1 / (1 << 14)
#: Terms in a host that list keepers block, the seed of the rejected URLs beside what rules block.
REJECTED_TERMS = ("ads", "adserver", "adult", "bets", "betting", "casino", "clickbait", "doorway", "jackpot", "lottery", "malware", "payday", "phish", "pills", "poker", "porn", "replica", "slots", "spam", "tracker", "track", "viagra", "warez", "xxx")


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    return pages.withColumns({"host": F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": path})


def rule_column(rules: dict[str, str]) -> Column:
    """The longest rule that fits host and path, or null; ties are impossible, as equal rules are one."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def rule_verdict(rules: dict[str, str]) -> Column:
    verdict = F.lit(None).cast("string")
    for rule, what in rules.items():
        verdict = F.when(F.col("rule") == rule, F.lit(what)).otherwise(verdict)
    return verdict


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each order, the hash of the context of every character and that of the context with the character; and the row offsets.

    Texts are lower-cased, digits are one character, and each ends with a 0.
    """
    raw, offsets = utf8(pc.utf8_lower(pc.fill_null(column, "")))
    n = len(offsets) - 1
    wide = np.insert(raw, offsets[1:], 0)
    at = offsets + np.arange(n + 1)
    wide = np.where((wide >= 48) & (wide <= 57), 48, wide).astype(U64)
    position = np.arange(len(wide)) - np.repeat(at[:-1], np.diff(at))
    context = np.zeros(len(wide), U64)
    contexts, joined = [], []
    for k in range(ORDER + 1):
        if k:
            past = np.zeros(len(wide), U64)
            past[k:] = wide[:-k]
            context = context * U64(0x100000001B3) + np.where(position >= k, past + U64(1), U64(0))
        salted = mix(context + U64(k << 56))
        contexts.append(salted)
        joined.append(mix(salted + wide + U64(1)))
    return np.array(contexts), np.array(joined), at


def _codes(column: pa.Array, bits: tuple[int, ...] = (BITS,) * (ORDER + 1)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_hashes cut to so many bits for each order, the places in the tables."""
    contexts, joined, at = _hashes(column)
    down = np.array([64 - b for b in bits], U64)[:, None]
    return (contexts >> down).astype(np.int32), (joined >> down).astype(np.int32), at


@dataclass
class MarkovModel:
    """Counts by order and hash: of contexts, of their different continuations, and of contexts with a character."""

    contexts: list[np.ndarray] = field(default_factory=lambda: [np.zeros(1 << BITS, np.float32) for _ in range(ORDER + 1)])
    kinds: list[np.ndarray] = field(default_factory=lambda: [np.zeros(1 << BITS, np.float32) for _ in range(ORDER + 1)])
    joined: list[np.ndarray] = field(default_factory=lambda: [np.zeros(1 << BITS, np.float32) for _ in range(ORDER + 1)])

    @classmethod
    def train(cls, column: pa.Array) -> MarkovModel:
        model = cls()
        contexts, joined, _ = _hashes(column)
        for k in range(ORDER + 1):
            model.put(k, BITS, contexts[k], joined[k], np.ones(len(contexts[k]), np.int64))
        return model

    def put(self, k: int, bits: int, contexts: np.ndarray, joined: np.ndarray, n: np.ndarray) -> None:
        """The tables of order k, of 2 ** bits places, from the counts of n-grams by their hashes."""
        a, b = (contexts >> U64(64 - bits)).astype(np.int64), (joined >> U64(64 - bits)).astype(np.int64)
        pairs = np.unique(a << bits | b) >> bits
        self.set(k, bits, (a, n), (pairs, np.ones(len(pairs))), (b, n))

    def set(self, k: int, bits: int, contexts: tuple, kinds: tuple, joined: tuple) -> None:
        """The tables of order k from (places, numbers) of each."""
        self.contexts[k], self.kinds[k], self.joined[k] = (np.bincount(at, n, 1 << bits).astype(np.float32) for at, n in (contexts, kinds, joined))
        self.kinds[k] = np.minimum(self.kinds[k], 65535).astype(np.uint16)

    def log_likelihood(self, contexts: np.ndarray, joined: np.ndarray, at: np.ndarray) -> np.ndarray:
        p = np.full(contexts.shape[1], 1 / 257)
        for k in range(ORDER + 1):
            n, t = self.contexts[k][contexts[k]].astype(np.float64), self.kinds[k][contexts[k]].astype(np.float64)
            p = np.where(n > 0, (np.minimum(self.joined[k][joined[k]], n) + t * p) / np.maximum(n + t, 1), p)
        return segment_sum(np.log(p), at)


@dataclass
class UrlModel:
    accepted: MarkovModel | None = None
    rejected: MarkovModel | None = None
    threshold: float = 0.0
    bits: tuple[int, ...] = (BITS,) * (ORDER + 1)
    shipped: Broadcast | None = None  # of a model with the same tables

    def ratio(self, column: pa.Array) -> np.ndarray:
        if self.accepted is None or self.rejected is None:
            return np.zeros(len(column))
        contexts, joined, at = _codes(column, self.bits)
        size = np.diff(at)
        difference = (self.accepted.log_likelihood(contexts, joined, at) - self.rejected.log_likelihood(contexts, joined, at)) / size
        return np.where(size > 1, difference, 0.0)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of keys (part, context, joined), and the sums of n for each."""
    order = np.lexsort((keys[0], keys[1], keys[2]))
    keys, n = keys[:, order], n[order]
    start = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
    return keys[:, start], np.add.reduceat(n, start)


def _counter(places: tuple[int, ...], most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How often each n-gram, by its places, is in the URLs of each label; part is twice the order, and one more for accepted URLs."""
    kinds = ["part", "context", "joined", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros((3, 0), np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for part in text_parts(batch, "url"):
                for label in (False, True):
                    contexts, joined, _ = _codes(part.column("url").filter(pc.equal(part.column("accepted"), label)), places)
                    if not contexts.shape[1]:
                        continue
                    for k in range(ORDER + 1):
                        own = np.array([np.full(contexts.shape[1], 2 * k + label), contexts[k], joined[k]], np.int64)
                        own, m = _summed(own, np.ones(own.shape[1], np.int64))
                        keys, n = np.concatenate([keys, own], 1), np.concatenate([n, m])
                if len(n) > most:
                    keys, n = _summed(keys, n)
                    if len(n) > most // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*keys, n)], kinds)
                        keys, n = keys[:, :0], n[:0]
        if len(n):
            keys, n = _summed(keys, n)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*keys, n)], kinds)

    return count


def fit(labelled: DataFrame) -> UrlModel:
    """A model of labelled(url, accepted boolean), of all its rows. A fifth of the URLs, by their hash, sets the threshold: the least ratio that
    rejects at most one in a hundred of the held-out accepted URLs and, above that, parts the two labels with the fewest errors,
    each label weighing the same."""
    labelled = labelled.where("url is not null and accepted is not null").select("url", "accepted")
    if len(labelled.groupBy("accepted").agg(F.count("*")).collect()) < 2:
        return UrlModel()
    held = F.pmod(F.xxhash64("url", F.lit("held")), F.lit(5)) == 0
    grams = labelled.where(~held).mapInArrow(_counter(PLACES, HELD), "part long, context long, joined long, n long").groupBy("part", "context", "joined").agg(F.sum("n").alias("n"))
    grams = stored(grams, "url-grams")
    contexts = grams.groupBy("part", F.col("context").alias("at")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    joined = grams.groupBy("part", F.col("joined").alias("at")).agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("kinds"))
    tables = stored(contexts.unionByName(joined), "url-tables")
    model = UrlModel(MarkovModel(), MarkovModel(), bits=PLACES)
    for orders in ((0, 1, 2), (3,), (4,), (5,)):  # what the driver holds at a time is bounded by the places of these
        got = tables.where(F.col("part").isin(*(2 * k + label for k in orders for label in (0, 1)))).toArrow()
        part, at, n, kinds = (got[c].to_numpy() for c in ("part", "at", "n", "kinds"))
        for k in orders:
            for label, own in ((1, model.accepted), (0, model.rejected)):
                context, join = (part == 2 * k + label) & (kinds > 0), (part == 2 * k + label) & (kinds == 0)
                own.set(k, PLACES[k], (at[context], n[context]), (at[context], kinds[context]), (at[join], n[join]))
    model.shipped = labelled.sparkSession.sparkContext.broadcast(UrlModel(model.accepted, model.rejected, bits=PLACES))
    model.threshold = _threshold(labelled.where(held), model.shipped)
    return model


def _threshold(held: DataFrame, shipped: Broadcast) -> float:
    """The threshold of all held-out URLs, from counts and extremes of their ratios in bins: all that is counted is exact, of the
    ratios in one bin of a label the least is tried."""

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, "url"):
                yield pa.RecordBatch.from_arrays([part.column("accepted"), pa.array(shipped.value.ratio(part.column("url")))], ["accepted", "ratio"])

    bins = held.mapInArrow(ratios, "accepted boolean, ratio double").groupBy("accepted", F.floor(F.col("ratio") / BIN).alias("bin"))
    got = bins.agg(F.count("*").alias("n"), F.min("ratio").alias("low"), F.max("ratio").alias("high")).toArrow()
    accepted, bin, n, low, high = (got[c].to_numpy() for c in ("accepted", "bin", "n", "low", "high"))
    if accepted.all() or not accepted.any():
        return 0.0
    at = np.unique(np.concatenate([[0.0], low]))
    # a bin counts as below if all of it is; the least ratio of one label can split the bin of the other, which then counts as not below
    below = lambda label: np.concatenate([[0], np.cumsum(n[accepted == label][np.argsort(high[accepted == label])])])[np.searchsorted(np.sort(high[accepted == label]), at)]
    good, bad = below(True), below(False)
    errors = good / n[accepted].sum() + 1 - bad / n[~accepted].sum()
    errors[_most_below(low[accepted], n[accepted], at) > 0.01 * n[accepted].sum()] = np.inf
    best = at[np.flatnonzero(errors == errors.min())[-1]]
    under = high[~accepted][high[~accepted] < best]
    return float((best + (under.max() if len(under) else best)) / 2)


def _most_below(low: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many ratios may be below each of at: those of all bins that begin below."""
    order = np.argsort(low)
    return np.concatenate([[0], np.cumsum(n[order])])[np.searchsorted(low[order], at)]


def labelled_by(pages: DataFrame, rules: dict[str, str], terms: tuple[str, ...] = REJECTED_TERMS) -> DataFrame:
    """url and accepted of the URLs that no rule decides, on which alone the model's verdict is asked: rejected are those that have one
    of the terms as a part of their host."""
    judged = with_host_path(pages).withColumn("rule", rule_column(rules)).where("host != '' and rule is null")
    return judged.select("url", (~F.exists(F.split("host", r"[.\-_]"), lambda part: part.isin(*terms))).alias("accepted"))


def judge(pages: DataFrame, rules: dict[str, str], model: UrlModel) -> DataFrame:
    """pages with host, path, rule, ratio and verdict of every url."""
    judged = with_host_path(pages).withColumn("rule", rule_column(rules)).withColumn("verdict", rule_verdict(rules))
    keep = [c for c in judged.columns if c not in ("ratio", "verdict")]
    schema = judged.select(*keep).schema.add("ratio", "double").add("verdict", "string")
    shipped, threshold = model.shipped or pages.sparkSession.sparkContext.broadcast(model), model.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, "url"):
                ratio = shipped.value.ratio(part.column("url"))
                verdict = pc.coalesce(part.column("verdict"), pa.array(np.where(ratio >= threshold, "allow", "block"), pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(ratio), verdict], [*keep, "ratio", "verdict"])

    return judged.select(*keep, "verdict").mapInArrow(run, schema)
