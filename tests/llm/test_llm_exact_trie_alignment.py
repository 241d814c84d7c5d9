"""Exact duplicates, the prefix trie and the alignment of tokenizers: SQL, brute force, and odd input."""

import hashlib
import random
import string
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from statloom.llm import alignment, exact_dedup, prefix_trie, queries

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def against_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    found = queries.QUERIES[name](spark, data)
    columns = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    got = [tuple(r) for r in found.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_exact_dedup"])
def test_sql(spark, data, name):
    against_sql(spark, data, name)


# exact duplicates


def naive_groups(rows):
    by = defaultdict(list)
    for doc_id, text in rows:
        by[(text or "").translate(LOWER)].append(doc_id)
    return by


def check_groups(rows, found):
    by = naive_groups(rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found) == sorted((i is None, i or 0) for i, _ in rows)
    want = Counter()
    for text, ids in by.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            want[i, max(known) if known else None, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == want
    kept = Counter((r["doc_id"], r["text_sha256"]) for r in found if r["kept"])
    assert kept == Counter({(max((i for i in ids if i is not None), default=None), hashlib.sha256(t.encode()).hexdigest()): 1 for t, ids in by.items()})


@pytest.mark.parametrize("prefix, bits", [(256, 1 << 27), (2, 1 << 15)])
def test_exact_dedup(spark, monkeypatch, prefix, bits):
    """Texts of one length, of one beginning, that differ in non-ASCII case, and filters so small that most keys share bits."""
    monkeypatch.setattr(exact_dedup, "PREFIX", prefix)
    monkeypatch.setattr(exact_dedup, "FILTER_BITS", bits)
    rng = random.Random(prefix)
    texts = [None, "", "ÄB", "äb", "Äb", "äB", "K", "K", "k", "x" * 300_000, "X" * 300_000, "x" * 299_999 + "y"]
    texts += ["".join(rng.choice("aAbB ") for _ in range(rng.randint(0, 6))) for _ in range(500)]
    rows = [(rng.randint(0, 400), t) for t in texts] + [(None, "only here"), (None, "null twice"), (None, "null twice"), (7, "again"), (7, "again"), (7, "AGAIN")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, keep_id string, GROUP_SIZE int").repartition(5)
    check_groups(rows, exact_dedup.mark(docs, digest="text_sha256").collect())
    assert exact_dedup.mark(docs, carry=docs.columns).columns == ["doc_id", "text", "keep_id", "group_size", "kept"]
    left = exact_dedup.deduplicated(docs)
    assert left.columns == ["doc_id", "text"] and left.count() == len(naive_groups(rows))
    assert exact_dedup.mark(docs.where("false"), digest="text_sha256").count() == 0


def test_exact_dedup_of_one_hot_group(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("copy "), "id")).otherwise(F.lit("The same")).alias("text"))
    found = exact_dedup.mark(docs)
    assert found.where("group_size = 4000 and keep_id = 5999").count() == 4000 and found.where("kept").count() == 2001
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# prefix trie


def naive_nodes(rebuilt):
    """{prefix: (conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends)} of {conv_id: [(role, text)]}."""
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) if children[p] else 1
        saved[p] = sum(saved[c] for c in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if len(rebuilt[c]) == len(p))))
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got_nodes(found):
    return sorted((tuple(r) for r in found.select(*FIELDS).collect()), key=repr)


@pytest.mark.parametrize("seed, convs, ranges", [(1, 300, 3), (2, 300, 40), (3, 60, 60), (4, 2, 5), (5, 900, 150)])
def test_trie(spark, monkeypatch, seed, convs, ranges):
    """Few different turns, so that prefixes, whole conversations and runs of equal ones go over many ranges."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    monkeypatch.setattr(prefix_trie, "BLOCK", 2)
    rng = random.Random(seed)
    rebuilt = {}
    for c in rng.sample(range(-50, 2000), convs):
        rebuilt[c] = [] if rng.random() < 0.03 else [(rng.choice("ua"), "t" * rng.randint(0, 2)) for _ in range(rng.choice((1, 2, 3, 6)))] if rng.random() < 0.7 else [("u", "hot")] * rng.randint(1, 4)
    rows = [(c, k, *t) for c, turns in rebuilt.items() for k, t in enumerate(turns)]
    rng.shuffle(rows)
    arrays = prefix_trie.turn_arrays(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    turnless = spark.createDataFrame([(c, bytearray()) for c, turns in rebuilt.items() if not turns] or [(0, bytearray())], "conv_id long, turns binary")
    if any(not turns for turns in rebuilt.values()):
        arrays = arrays.unionByName(turnless)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        assert got_nodes(prefix_trie.nodes(arrays)) == naive_nodes(rebuilt)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def naive_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    said = {c: [(role, text) for *_, role, text in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = said.get(c - c % 100, [])[:h] + turns[h:]
    return out


def test_trie_of_rebuilt_conversations(spark, tmp_path):
    """The query on odd rows: nulls, ties, repeated rows, conversations without turns of their own left, absent bases, a clashing column."""
    rng = random.Random(9)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 260), 300, 999]:
        for k in range(rng.choice((1, 1, 2, 4, 9))):
            rows.append((c, None if rng.random() < 0.1 else k if rng.random() < 0.9 else 0, rng.choice(("user", "assistant", None)), rng.choice(("", None, "a", "Ää", "long " * 50))))
    rows += rows[:7] + [(None, 1, "user", "nobody's")]
    spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n_convs int, turns string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert got_nodes(queries.op11_prefix_trie(spark, str(tmp_path))) == naive_nodes(naive_rebuilt(rows))


def test_trie_of_nothing_and_texts_of_nodes(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert prefix_trie.nodes(prefix_trie.turn_arrays(spark.createDataFrame([], kind))).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", "Hi"), (1, 1, None, "Yes"), (2, 0, "user", "Hi")], kind)
    found = prefix_trie.with_turns(prefix_trie.nodes(prefix_trie.turn_arrays(turns)), turns).orderBy("depth").collect()
    assert [(r["depth"], r["n_convs"], r["role"], r["text"]) for r in found] == [(0, 2, None, None), (1, 2, "user", "Hi"), (2, 1, None, "Yes")]


def test_trie_of_one_long_conversation(spark):
    """Many turns of one conversation, and one that leaves it half way."""
    turns = spark.range(5000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.col("id").cast("string").alias("text"))
    turns = turns.unionByName(turns.where("turn < 2500").withColumn("conv_id", F.lit(2)))
    found = prefix_trie.nodes(prefix_trie.turn_arrays(turns))
    assert found.count() == 5001
    root = found.where("depth = 0").first()
    assert (root["n_convs"], root["n_leaves"], root["saved_tokens"]) == (2, 1, sum(len(str(k)) for k in range(2500)))


# alignment


def token_bytes():
    """Each tokenizer's ids of a text, and the bytes of each id."""
    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}
    of_a = lambda i: bytes(alphabet[c] for c in a.id_to_token(i))
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return lambda t: a.encode(" " + t, add_special_tokens=False).ids, lambda t: b.encode(t), of_a, of_b


def naive_alignment(rows):
    ids_a, ids_b, of_a, of_b = token_bytes()
    links, out = {}, {}
    for doc_id, text in rows:
        out[doc_id], links[doc_id] = [0, 0, 0, 0, ""], []
        if not text:
            continue
        a, b = ids_a(text), ids_b(text)
        raw = f" {text}".encode()
        if b"".join(map(of_a, a)) != raw or b"".join(map(of_b, b)) != raw:
            continue
        spans = []
        for ids, of in ((a, of_a), (b, of_b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at := at + len(of(i)), i))
            spans.append(own)
        common = {e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}
        links[doc_id] = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        groups, low = [], 0
        for high in sorted(common):
            groups.append("|".join(",".join(str(i) for s, e, i in own if low <= s and e <= high) for own in spans))
            low = high
        out[doc_id] = [len(a), len(b), len(common), len(links[doc_id]), hashlib.sha256(";".join(groups).encode()).hexdigest()]
    counts = Counter(p for found in links.values() for p in found)
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return {d: (*out[d][:4], sum(counts[p] == most[p[1]] for p in links[d]), sum(counts[p] for p in links[d]), out[d][4]) for d in out}


ODD = [None, "", " ", "  ", "\n", "\n ", " \n", "a\r\nb\r", "tab\there  two", "<s> </s><unk>", "<|endoftext|>x", "U+2581 ▁ mark", "日本語 テスト 🎉", "\x00 \x1c x", "　wide ", "x" * 70 + " " + "y" * 300, "don't I'LL", "ÄÖÜ ß"]


@pytest.mark.parametrize("lookup, keep", [(1 << 22, 400_000), (0, 50)])
def test_alignment(spark, monkeypatch, lookup, keep):
    monkeypatch.setattr(alignment, "LOOKUP", lookup)
    monkeypatch.setattr(alignment, "KEEP", keep)
    rng = random.Random(lookup)
    texts = ODD + ["".join(rng.choice(["a", "Word", " ", " ", "\n", "é", "日", "ing", ".", "12", "  ", "\t"]) for _ in range(rng.randint(1, 40))) for _ in range(120)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n_a int, a string").repartition(4)
    found = alignment.align(docs, BYTES, PIECES)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {r["doc_id"]: tuple(r)[1:] for r in found.collect()} == naive_alignment(rows)
    assert alignment.align(docs.where("false"), BYTES, PIECES).count() == 0


def test_alignment_of_whole_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy(F.length("text")).limit(120).select("doc_id", "text").collect()
    long = [(10**6, "One word after another, and so on.\n" * 3000), (10**6 + 1, "One word after another, and so on.\n" * 3000)]
    rows = [tuple(r) for r in docs] + [(k, t[:3000]) for k, t in long]
    found = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), BYTES, PIECES).collect()}
    assert found == naive_alignment(rows)
    whole = alignment.align(spark.createDataFrame(long, "doc_id long, text string"), BYTES, PIECES).collect()
    assert whole[0][1:] == whole[1][1:] and whole[0]["n_links"] == whole[0]["n_a"] + whole[0]["n_b"] - whole[0]["n_groups"]
