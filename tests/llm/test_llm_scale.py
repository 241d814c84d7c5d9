"""Results against naive versions written with dictionaries and loops, and what must hold however large a table or a group is."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from statloom.llm import chat, decontaminate, fingerprint, html_text, language_id, licenses, near_duplicates, quality, queries, shared, url_filter

MASK, BASE = (1 << 64) - 1, 0x9E3779B97F4A7C15
WORD = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")


def words(text):
    return WORD.findall((text or "").lower())


def mixed(h):
    h &= MASK
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & MASK
    h = (h ^ h >> 27) * 0x94D049BB133111EB & MASK
    return h ^ h >> 31


def hashed(raw):
    total, up = len(raw), 1
    for b in raw:
        total, up = total + (b + 1) * up, up * BASE & MASK
    return mixed(total)


@pytest.fixture(scope="module")
def docs(spark, data):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def naive_quality(model, text):
    tokens = [m[0] for m in re.finditer(rb"[A-Za-z0-9\x80-\xff]+|([!-/:-@\[-`{-~])\1*", (text or "").encode())]
    lexical, shapes, last = [], [], None
    for t in tokens:
        lexical.append(hashed(bytes(b + 32 if 65 <= b <= 90 else b for b in t)))
        ups, digits = sum(65 <= b <= 90 for b in t), sum(48 <= b <= 57 for b in t)
        if not re.match(rb"[A-Za-z0-9\x80-\xff]", t):
            shapes.append(16 + (t[0] + 2) * 4 + min(len(t), 3))
            continue
        case = 0 if not ups else 1 if ups == 1 and 65 <= t[0] <= 90 else 2 if ups == len(t) - digits else 3
        shapes.append(15 if lexical[-1] == last else case * 3 + (0 if not digits else 2 if digits == len(t) else 1))
        last = lexical[-1]
    shapes = [mixed(s + 1) for s in shapes]
    total = 0.0
    for of, n, salt in ((lexical, 1, 1), (lexical, 2, 2), (shapes, 1, 3), (shapes, 2, 4), (shapes, 3, 5)):
        for k in range(len(tokens)):
            h = of[k] + salt
            for back in range(1, n):
                h = h * BASE + (of[k - back] if k >= back else 0)
            total += float(model.weights[mixed(h) >> 64 - quality.BITS])
    return 1 / (1 + math.exp(-(model.bias + quality.SCALE * total / max(1, len(tokens)))))


def test_quality_scores_against_a_naive_scorer(spark, data, docs):
    table, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = quality.fit(table.select("doc_id", "text"), labels.where(queries.fold("doc_id", 5) != 0))
    found = {r["doc_id"]: r for r in queries.op1_quality(spark, data).collect()}
    assert set(found) == set(docs)
    for k in sorted(docs)[:80]:
        assert found[k]["score"] == pytest.approx(naive_quality(model, docs[k]["text"]), abs=1e-4)
        assert found[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0)


def naive_language(model, text):
    raw = re.sub(rb"[^a-z\x80-\xff]+", b" ", (text or "").lower().encode())
    if not raw.strip() or not model.langs:
        return "und", 0.0
    total, count = np.zeros(len(model.pairs)), 0
    for n in (2, 3, 4):
        for k in range(len(raw) - n + 1):
            h = 0
            for b in raw[k : k + n]:
                h = (h * 257 + b) % (1 << 32)
            total += model.weights[((h * 2654435761 + (n - 1) * 0x1F3779B1) % (1 << 32) >> 20) % language_id.BUCKETS]
            count += 1
    margin = dict(zip(model.pairs, total / max(1, count) + model.biases))

    def winner(labels, families):
        wins, sums, least = Counter(), Counter(), dict.fromkeys(labels, 1.0)
        for (a, b, of), m in margin.items():
            if of == families and a in labels and b in labels:
                wins[a if m > 0 else b] += 1
                sums[a] += math.tanh(m)
                sums[b] -= math.tanh(m)
                sure = 1 / (1 + math.exp(-2 * m))
                least[a], least[b] = min(least[a], sure), min(least[b], 1 - sure)
        best = max(labels, key=lambda x: (wins[x], sums[x]))
        return best, least[best]

    family, sure = winner(sorted({model.family(x) for x in model.langs}), True)
    lang, then = winner([x for x in model.langs if model.family(x) == family], False)
    return lang, sure * then


def test_languages_against_a_naive_scorer(spark, data, docs):
    table = spark.read.parquet(f"{data}/documents.parquet")
    model = language_id.fit(table.where(queries.fold("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    found = {r["doc_id"]: r for r in queries.op10_language_id(spark, data).collect()}
    short = [k for k in sorted(docs) if len(docs[k]["text"] or "") < 4000][:60]
    for k in short:
        lang, score = naive_language(model, docs[k]["text"])
        assert found[k]["lang_pred"] == lang and found[k]["score"] == pytest.approx(score, abs=1e-4)


def test_url_verdicts_against_a_naive_model(spark, data):
    data = data.replace("0.001", "0.01")
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url")
    labelled = url_filter.labelled_by(pages, queries.URL_RULES)
    held = F.pmod(F.xxhash64("url", F.lit("held")), F.lit(5)) == 0
    counts = {True: defaultdict(Counter), False: defaultdict(Counter)}

    def contexts(url):
        text = re.sub("[0-9]", "0", url.lower()) + "\0"
        for k, c in enumerate(text):
            yield c, [tuple(text[k - b] if k >= b else None for b in range(1, n + 1)) for n in range(url_filter.ORDER + 1)]

    for r in labelled.where(~held).collect():
        for c, before in contexts(r["url"]):
            for b in before:
                counts[r["accepted"]][b][c] += 1

    def log_likelihood(url, label):
        total = 0.0
        for c, before in contexts(url):
            p = 1 / 257
            for b in before:
                own = counts[label].get(b)
                if own:
                    n, kinds = sum(own.values()), len(own)
                    p = (own[c] + kinds * p) / (n + kinds)
            total += math.log(p)
        return total

    threshold = url_filter.fit(labelled).threshold
    found = {r["page_id"]: r for r in queries.op5_url_filter(spark, data).collect()}
    apart = []
    for r in pages.collect():
        ratio = (log_likelihood(r["url"], True) - log_likelihood(r["url"], False)) / (len(r["url"]) + 1)
        got = found[r["page_id"]]
        apart.append(abs(ratio - got["ratio"]))
        if got["rule"] is None and abs(ratio - threshold) > 0.02:
            assert got["verdict"] == ("allow" if ratio >= threshold else "block")
    assert np.median(apart) < 0.01  # places of hashed counts may be shared


def naive_fingerprint(text):
    exact, sketch = [0] * 16, [0] * 256
    for line in text.split("\n"):
        digest = hashlib.shake_256(line.encode()).digest(64)
        exact = [(e + int.from_bytes(digest[4 * k : 4 * k + 4], "little")) % (1 << 32) for k, e in enumerate(exact)]
        own = [hashed(w.encode()) for w in words(line)]
        grams = set()
        for k, w in enumerate(own):
            h = w + 1
            for back in (1, 2):
                h = mixed(h + (own[k - back] if k >= back else 0) * (2 * back + 1))
            grams.add(h)
        for h in grams:
            sketch[h >> 56] += 1 - 2 * (h >> 8 & 1)
    return exact, sketch


def naive_likeness(a, b):
    if a == b:
        return 1.0
    dot, x, y = (sum(p * q for p, q in zip(*s)) for s in ((a[1], b[1]), (a[1], a[1]), (b[1], b[1])))
    return max(0.0, dot / math.sqrt(x * y)) if x and y else 0.0


def test_fingerprints_against_a_naive_version(spark, data, docs):
    found = {r["doc_id"]: r for r in queries.op8_fingerprint(spark, data).collect()}
    order = sorted(docs)
    for k, after in list(zip(order, order[1:] + order[:1]))[:60] + [(order[-1], order[0])]:
        text, follow = docs[k]["text"] or "", docs[after]["text"] or ""
        q = len(text) // 4
        own, edited, other = (naive_fingerprint(t) for t in (text, text[: len(text) - q] + follow[:q], follow))
        for column, want in (("fingerprint", own), ("edited_fingerprint", edited)):
            exact, sketch = fingerprint.decode(found[k][column])
            assert exact.tolist() == want[0] and sketch.tolist() == want[1]
        assert found[k]["near_edited"] == pytest.approx(naive_likeness(own, edited)) and found[k]["near_next"] == pytest.approx(naive_likeness(own, other))


def test_licenses_are_those_of_brute_force(spark, data, docs):
    """Found is what some stretch as long as the template holds 0.8 of; what is found, a stretch of three times its length holds."""
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    found = {(r["doc_id"], r["license"]): r["start_word"] for r in queries.op9_licenses(spark, data).collect()}
    want, loose = set(), set()
    for k, r in docs.items():
        own = grams(words(r["text"]))
        held = set(own)
        for name, texts in licenses.TEMPLATES.items():
            for t in map(grams, map(words, texts)):
                need = math.ceil(0.8 * len(set(t)) - 1e-9)
                if len(held & set(t)) < need:
                    continue
                hits = [(i, g) for i, g in enumerate(own) if g in set(t)]
                for width, where in ((len(t), want), (3 * len(t) + 8, loose)):
                    if any(len({g for i, g in hits if start <= i < start + width}) >= need for start, _ in hits):
                        where.add((k, name))
    assert want and want <= set(found) <= loose


def test_decontamination_against_brute_force(spark):
    """All pairs of which some window has the words in order and the answer that verification asks for."""
    random = np.random.default_rng(11)
    vocabulary = [f"w{k}" for k in range(4000)]
    common = [f"c{k}" for k in range(60)]
    say = lambda n: [str(x) for x in random.choice(common if random.random() < 0.3 else vocabulary, n)]
    items = [(k, " ".join(x for _ in range(4) for x in say(int(random.integers(3, 16))))) for k in range(30)]
    rows = []
    for k in range(120):
        w = items[k % 30][1].split()
        keep = (1.0, 0.9, 0.8, 0.7, 0.5, 0.2)[k // 30 if k % 2 else k % 6]
        changed = [x if random.random() < keep else say(1)[0] for x in w]
        rows.append((k, " ".join([*say(40), *changed, *say(40)])))
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["item_id"], r["doc_id"]) for r in found.collect()}

    def subsequence(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row
            row = [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
        return row[-1]

    frequency = Counter(w for _, t in rows for w in set(words(t)))
    want, possible = set(), set()
    for item, text in items:
        passage = words(text)
        assert decontaminate.SHORT <= len(passage) <= decontaminate.PASSAGE
        some = sorted(set(passage), key=lambda w: frequency[w])
        least = frequency[some[-(-len(some) // 5) - 1]]  # the rarest fifth, of equals any
        for doc, own in rows:
            w = words(own)
            order = subsequence(passage, w)
            rare = [x for x in some if frequency[x] <= least]
            if order >= 0.6 * len(passage) and sum(x in w for x in rare) >= 0.5 * -(-len(some) // 5):
                possible.add((item, doc))
                if order >= 0.7 * len(passage) and all(x in w for x in rare):
                    want.add((item, doc))
    assert len(want) > 30 and want <= got <= possible


def test_samples_have_rows_at_any_size(spark):
    """Shares as small as those of 10 ** 12 rows still take rows, and about as many as they say."""
    rows = spark.range(2_000_000)
    for share in (1.0, 0.1, 1e-3, 1e-5):
        n = rows.where(shared.hashed_below(F.lit(share), F.col("id"))).count()
        assert abs(n - share * 2e6) <= 6 * math.sqrt(share * 2e6)
    for n in (10**9, 10**12):
        assert spark.range(1).select((F.lit(300 / n) * float(1 << 62)).cast("long").alias("x")).first()["x"] > 0
    docs = rows.limit(1000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.lit("en").alias("lang"))
    assert language_id.sampled(docs, {"en": 1000, "de": 10**12}, 200).count() == pytest.approx(100, abs=50)
    labels = docs.select("doc_id", F.lit(1).alias("label"))
    assert quality.sampled(docs, labels, 1000, 100).count() == pytest.approx(100, abs=50)


def test_one_key_of_most_rows_fills_no_sample(spark):
    hot = spark.range(50_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same words").alias("text"), F.lit("en").alias("lang"))
    assert language_id.sampled(hot, {"en": 1}, 1200).count() == 1
    labels = hot.select("doc_id", F.lit(1).alias("label"))
    assert quality.sampled(hot.limit(100), labels, 1, 4000).count() == 1
    found = fingerprint.edited(hot.limit(3000))
    assert found.count() == 3000 and found.select("fingerprint", "edited_fingerprint", "near_next").distinct().count() == 1


def test_fingerprints_of_thousands_of_partitions(spark, data):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5000")
    try:
        plan = fingerprint.edited(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert "5000" in plan


@pytest.mark.parametrize("times", [32_768, 65_536, 300_000])
def test_fingerprints_of_many_equal_lines(times):
    line = "one two three four five"
    a, b = (fingerprint.decode(fingerprint.fingerprint("\n".join([line] * n))) for n in (times, times - 1))
    assert fingerprint.likeness((a[0][None], a[1][None]), (b[0][None], b[1][None]))[0] > 0.99


def jaccard(texts):
    sets = {k: {tuple(words(t)[i : i + 5]) for i in range(max(1, len(words(t)) - 4))} for k, t in texts.items()}
    root, n = {k: k for k in texts}, dict.fromkeys(texts, 0)
    for a in texts:
        for b in texts:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                n[a] += 1
                n[b] += 1
                x, y = root[a], root[b]
                root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
    return {k: (root[k], n[k]) for k in texts}


@pytest.mark.parametrize("giant", [8192, 20])
def test_near_duplicates_of_hot_groups_and_chains(spark, monkeypatch, giant):
    """Copies, near copies and a chain of ever other texts, with every group taken as large or as usual: as brute force has it."""
    monkeypatch.setattr(near_duplicates, "GIANT", giant)
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)
    monkeypatch.setattr(shared, "HOT", 8)
    random = np.random.default_rng(2)
    texts, w = {}, [f"w{k}" for k in range(120)]
    for k in range(90):  # a chain: each a few words further
        w = w[2 + k % 5 :] + [f"n{k}x{j}" for j in range(2 + k % 5)]
        texts[k] = " ".join(w)
    base = [f"b{k}" for k in range(80)]
    for k in range(100, 160):
        own = base.copy()
        for _ in range(int(random.integers(0, 4))):
            own[int(random.integers(0, 80))] = f"x{random.integers(0, 1000)}"
        texts[k] = " ".join(own)
    texts |= {200 + k: " ".join(base) for k in range(40)}
    found = near_duplicates.links(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found} == jaccard(texts)


def test_near_duplicates_at_exactly_the_threshold(spark):
    """Eight of ten 5-grams are shared by each text and the next: a chain of ties is one class, that of the least doc_id."""
    w = [f"w{k}" for k in range(40)]
    texts = {9 - k: " ".join(w[k : k + 13]) for k in range(6)}
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates.links(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert found == jaccard(texts) and {c for c, _ in found.values()} == {4} and found[9][1] == 1


def test_folds_of_null_ids(spark):
    got = spark.createDataFrame([(None,), (3,)], "doc_id long").select((queries.fold("doc_id", 5) == 0).alias("held")).collect()
    assert [r["held"] for r in got] == [False, zlib.crc32(b"3") % 5 == 0]


def test_stages_keep_columns_of_any_name(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name in ("_lang", "_sure", "_quality", "_rank", "__lang"):
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} of "), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, data)
        assert kept.columns == docs.columns
        wrong = kept.where(" or ".join(f"{c} is null or {c} != concat('{c} of ', doc_id)" for c in ("_lang", "_sure", "_quality", "_rank", "__lang")))
        assert wrong.count() == 0 and kept.count() > 0, name


def test_chat_of_ids_of_any_type(spark):
    rows = [("a-1", 0, "ann", "hi"), ("a-1", 1, "bob", "ho"), (None, 0, "ann", "alone")]
    found = chat.rotate(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    assert sorted((r["conv_id"] or "", r["perspective"], r["position"]) for r in found) == [("", "ann", 0), ("a-1", "ann", 0), ("a-1", "ann", 1), ("a-1", "bob", 0), ("a-1", "bob", 1)]


def test_html_without_its_article_element(spark, data):
    """Windows alone find the text that the article element names."""
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        bare = re.sub(r"</?article[^>]*>", "", r["html"])
        assert html_text.extract(bare) == html_text.extract(r["html"])


def test_a_word_is_merged_once():
    """With whatever marks and in either case; and what is met again moves on without a walk through all that was kept. Ids are the tokenizer's own."""
    import public_tokenizers

    from statloom.llm import packing

    class Walked(dict):
        def __iter__(self):
            raise AssertionError("walks through the dictionary")

    ids = packing.TokenIds(public_tokenizers.path("word_bpe_49k.json"))
    seen, merges = [], ids.merges
    ids.merges = SimpleNamespace(encode_batch_fast=lambda lines, **options: seen.extend(w for line in lines for w in line.split(" ")) or merges.encode_batch_fast(lines, **options))
    texts = ["Zorbing zorbing, zorbing. (zorbing) ZORBING!", "\u00c9lan \u00e9lan, x1 zorbing;"]
    want = [np.array(e.ids, "<u4").tobytes() for e in ids.whole.encode_batch_fast(texts, add_special_tokens=False)]
    assert ids.encode(texts) == want and seen.count("zorbing") == 1 and len(seen) == len(set(seen))
    ids.young, ids.old = {"": b""}, Walked(ids.young)
    assert ids.encode(texts) == want and len(seen) == len(set(seen))


def test_windows_decide_inside_a_named_part(spark, data):
    """Surges and dives of a line's own weight give the text that an article names, before the check; the check puts back what they cut off."""
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        found, _ = html_text.lines(r["html"])
        weight = np.array([size if text and rank == 2 else 0 for text, rank, size in found], float)
        kept = html_text.surge_to_dive(weight)
        assert [x[0] for x, stays in zip(found, kept) if stays and x[0] and x[1] == 2] == html_text.main_lines(found)
    found = [("x" * n, 2, size) for n, size in ((300, 300), (9, 0), (9, 0), (9, 0), (9, 0), (8, 8))]  # four lines of links, then a short one
    assert html_text.surge_to_dive(np.array([size for _, _, size in found], float)).tolist() == [True] + [False] * 5
    assert html_text.main_lines([("y" * 900, 0, 900), *found]) == [x[0] for x in found]


def test_a_line_between_two_runs_comes_once():
    assert html_text.main_lines([("x" * n, 0, n) for n in (300, 0, 8, 0, 300)]) == ["x" * 300, "x" * 8, "x" * 300]


def test_windows_against_brute_force():
    """On lines without links or names: what lies between surges and dives, by looking at every window."""
    random = np.random.default_rng(4)
    for _ in range(300):
        sizes = [int(random.choice([0, 0, 3, 8, 20, 90, 300])) for _ in range(int(random.integers(1, 25)))]
        found = [("x" * n, 0, n) for n in sizes]
        windows = [sum(sizes[max(0, k - html_text.WINDOW + 1) : k + 1]) for k in range(len(sizes) + html_text.WINDOW - 1)]
        surge = min(max(windows), max(html_text.LEAST, min(html_text.PARAGRAPH, html_text.SURGE * max(windows))))
        keep = set()
        for k, w in enumerate(windows):
            if w < surge or not w:
                continue
            low = high = k
            while low > 0 and windows[low - 1] >= min(surge, html_text.DIVE):
                low -= 1
            while high + 1 < len(windows) and windows[high + 1] >= min(surge, html_text.DIVE):
                high += 1
            keep |= {i for i in range(max(0, low - html_text.WINDOW + 1), min(len(sizes), high + 1)) if sizes[i]}
        assert html_text.main_lines(found) == [found[i][0] for i in sorted(keep)] if any(sizes) else html_text.main_lines(found) == []


@pytest.mark.parametrize("part", ["<script>", '<div class="main">', '<a "', "<p", "<!--", "</div>", "<b>x</b>", "&amp;<i"])
def test_html_takes_time_in_proportion(part):
    began = time.time()
    html_text.extract(part * (1_000_000 // len(part)))
    assert time.time() - began < 10


def test_a_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared.shared_dir(Session())


def test_empty_batches_give_no_words():
    assert url_filter._codes(pa.array([], pa.string()))[0].shape[1] == 0


def test_near_duplicates_have_one_rule_for_groups_of_any_size():
    """A pair that outlasts pruning and is similar enough, but meets in no band, is no link in a small group, as it is none in a large one."""
    random = np.random.default_rng(8)
    values = random.integers(0, 1 << 16, (1, near_duplicates.VALUES), dtype=np.uint16)
    apart = values.copy()
    apart[0, :: near_duplicates.ROWS] += 1  # one value of every band
    met = apart.copy()
    met[0, 0] = values[0, 0]
    shingles = np.sort(random.integers(0, 1 << 62, 100).astype(np.uint64)).tobytes()

    def rows(id, v):
        return pa.table({"id": [id], "values": [v.tobytes()], "shingles": pa.array([shingles], pa.binary()), "n": pa.array([100], pa.int32()), "copies": [1]})

    assert near_duplicates.prune(values, apart, np.array([0]), np.array([0]))[0].tolist() == [0]
    for other, links in ((apart, [0, 0]), (met, [1, 1])):
        found = near_duplicates._counted(rows(1, values), rows(2, other), False, None)
        assert found.column("links").to_pylist() == links
    band = int(near_duplicates._band_hashes(values.reshape(-1, near_duplicates.BANDS, near_duplicates.ROWS))[0, 0])
    assert near_duplicates._counted(rows(1, values), rows(2, met), False, band).column("links").to_pylist() == [1, 1]


def _passage_index(count, random, vocabulary, share, answers=None):
    """An index of passages of Zipf words, with a latent space of their TF-IDF matrix."""
    words = [vocabulary[random.choice(len(vocabulary), random.integers(12, 64), p=share)] for _ in range(count)]
    known = decontaminate.Vocabulary(np.unique(np.concatenate(words)))
    seen = np.zeros(len(known.terms))
    for _ in range(500):
        term = np.unique(known.find(vocabulary[random.choice(len(vocabulary), 300, p=share)]))
        seen[term[term >= 0]] += 1
    idf = np.log(502 / (seen + 1))
    rows = np.zeros((count, len(known.terms)))
    for k, w in enumerate(words):
        term, times = np.unique(known.find(w), return_counts=True)
        rows[k, term] = times * idf[term]
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    value, vector = np.linalg.eigh(rows @ rows.T)  # the singular vectors by way of the smaller side
    value, vector = value[-decontaminate.RANK :], vector[:, -decontaminate.RANK :]
    latent = rows.T @ vector / np.sqrt(np.maximum(value, 1e-12))
    rare = [s[np.lexsort([s, -idf[known.find(s)]])][: -(-len(s) // 5)] for s in map(np.unique, words)]
    return decontaminate.Index(known, idf, latent, np.arange(count), np.zeros(count, int), words, answers or rare)


def _zipf(n):
    share = 1 / np.arange(1, n + 1)
    return np.array([hashed(f"z{k}".encode()) for k in range(n)], np.uint64), share / share.sum()


@pytest.mark.parametrize("common", [decontaminate.COMMON, 2])
def test_latent_search_against_all_pairs(monkeypatch, common):
    """Every window with every passage, multiplied one by one: candidates are those whose cosine reaches the cut, and nothing but verification takes them away."""
    monkeypatch.setattr(decontaminate, "COMMON", common)
    random = np.random.default_rng(common)
    vocabulary, share = _zipf(3000)
    index = _passage_index(40, random, vocabulary, share)
    texts = []
    for k in range(60):
        text = vocabulary[random.choice(3000, random.integers(0, 90), p=share)]
        if k % 3:
            own = index.words[k % 40]
            text = np.concatenate([text[:30], np.where(random.random(len(own)) < 0.8, own, vocabulary[random.choice(3000, len(own), p=share)]), text[30:]])
        texts.append(text)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = {(int(r), int(p), int(s)): c for r, p, s, c, *_ in index.search(np.concatenate(texts), at)}
    want, doubtful = {}, set()
    for size, (passages, vectors) in index.by_window.items():
        for row, text in enumerate(texts):
            starts = {min(k, max(0, len(text) - size)) for k in range(0, max(1, len(text) - size + size // 4), size // 4)} if len(text) else set()
            for start in starts:
                term = index.vocabulary.find(text[start : start + size])
                vector = (index.idf[term[term >= 0], None] * index.latent[term[term >= 0]]).sum(axis=0)
                norm = np.linalg.norm(vector)
                for j, p in enumerate(passages):
                    cosine = float(vector @ vectors[:, j] / norm) if norm > 0 else 0.0
                    around = text[max(0, start - size // 2) : min(len(text), start + size) + size // 2]
                    if cosine >= decontaminate.CANDIDATE - 1e-4 and index.verify(p, around):
                        want[row, int(p), start] = cosine
                        if cosine < decontaminate.CANDIDATE + 1e-4:
                            doubtful.add((row, int(p), start))
    assert len(want) > 40 and want.keys() - doubtful <= found.keys() <= want.keys()
    assert all(found[k] == pytest.approx(want[k], abs=1e-4) for k in found)


def test_paraphrases_that_keep_six_in_ten_words_are_found():
    """Of planted passages with 0.60 to 0.70 of the words in order, nine in ten at least; the cosine alone rules out nine in ten pairs."""
    random = np.random.default_rng(12)
    vocabulary, share = _zipf(20_000)
    index = _passage_index(150, random, vocabulary, share)
    met = found = 0
    for k in range(450):
        own = index.words[k % 150]
        changed = np.where(random.random(len(own)) < 0.66, own, vocabulary[random.choice(20_000, len(own), p=share)])
        checked = index.verify(k % 150, changed)
        if checked and checked[0] < 0.7:
            text = np.concatenate([vocabulary[random.choice(20_000, 50, p=share)], changed, vocabulary[random.choice(20_000, 50, p=share)]])
            met += 1
            found += any(p == k % 150 for _, p, *_ in index.search(text, np.array([0, len(text)])))
    assert met > 40 and found >= 0.9 * met
    text = vocabulary[random.choice(20_000, 4000, p=share)]
    pairs = kept = 0
    for size, (passages, vectors) in index.by_window.items():
        for start in range(0, len(text) - size, size // 4):
            term = index.vocabulary.find(text[start : start + size])
            vector = (index.idf[term[term >= 0], None] * index.latent[term[term >= 0]]).sum(axis=0)
            pairs += len(passages)
            kept += int((vector @ vectors >= decontaminate.CANDIDATE * max(1e-12, np.linalg.norm(vector))).sum())
    assert kept < 0.1 * pairs


def test_search_of_a_long_text_with_answers_of_common_words():
    """16,000 words against 1,000 passages whose answers are of words that all texts have."""
    random = np.random.default_rng(13)
    vocabulary, share = _zipf(20_000)
    index = _passage_index(1000, random, vocabulary, share, [vocabulary[random.choice(40, 8)] for _ in range(1000)])
    text = vocabulary[random.choice(20_000, 16_000, p=share)]
    began = time.process_time()
    assert list(index.search(text, np.array([0, len(text)]))) == []
    assert time.process_time() - began < 20
