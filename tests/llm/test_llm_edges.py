"""Every operator over nulls, empty and very long texts, repeated rows, empty tables and extra columns of clashing names."""

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from statloom.llm import chat, decontaminate, fingerprint, html_text, language_id, licenses, near_duplicates, packing, quality, url_filter

LONG = "The quick brown fox jumps over the lazy dog and runs away. " * 4000
TEXTS = [None, "", " \n\t ", "...", "word", "eins zwei", LONG, LONG, "日本語 テスト", "a\nb\n\nc", "The house of the rising sun is in the town of the saints. " * 3, "Das Haus und die Straße sind nicht weit von der Stadt. " * 3]
SCHEMA = "doc_id long, text string, lang string, score double, lang_pred string, key string, range int, `values` string, id long, n int, label int, fingerprint string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en" if k % 2 else "de", 0.5, "x", "k", 1, "v", 7, 1, 1, "f") for k, t in enumerate(TEXTS)]
    rows += [rows[9], rows[10], (None, "no id at all here", None, None, None, None, None, None, None, None, None, None), (3, "another text of a known id", "en", 0.1, "x", "k", 1, "v", 7, 1, 1, "f")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where(F.lit(False))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2) for k in range(12)] + [(1, None), (None, 1), (999, 1), (2, 5)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "The house of the rising sun is in the town"), (2, None), (3, ""), (None, "nothing"), (1, "The house of the rising sun is in the town")], "item_id long, text string")


def test_language(odd, empty):
    model = language_id.fit(odd)
    found = language_id.identify(odd, model).collect()
    assert len(found) == odd.count()
    for r in found:
        assert 0 <= r["score"] <= 1
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert r["lang_pred"] == "und" and r["score"] == 0
        else:
            assert r["lang_pred"] in ("en", "de")
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd, language_id.fit(empty)).collect()} == {"und"}
    single = language_id.fit(odd.where("lang = 'en'"))
    assert {r["lang_pred"] for r in language_id.identify(odd, single).collect()} == {"und", "en"}


def test_quality(odd, empty, labels):
    model = quality.fit(odd, labels)
    found = quality.score(odd, model).collect()
    assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
    alone = quality.QualityModel(model.bias).score(pa.array([""]))[0]
    assert [r["score"] for r in found if r["text"] in (None, "")] == pytest.approx([alone] * 2)
    assert quality.score(empty, model).count() == 0
    assert {r["score"] for r in quality.score(odd, quality.fit(odd, labels.where("false"))).collect()} == {0.5}


def test_packing(odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    found = packing.pack(odd, path).collect()
    assert sum(r["length"] for r in found) == sum({(r["doc_id"], r["doc_tokens"], r["ids_crc32"], r["start"], r["sequence_id"], r["offset"]): r["length"] for r in found}.values())
    assert {r["doc_id"] for r in found} == {r["doc_id"] for r in odd.select("doc_id").collect()}
    assert [r["doc_tokens"] for r in found if r["doc_id"] == 0] == [1]
    assert packing.pack(empty, path).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, path, size=1000)


def test_html(spark):
    pages = spark.createDataFrame([(1, None, "t", 1), (2, "", "t", 2), (3, "<p>a<p>b", "t", 3), (4, "<" * 50 + "p", "t", 4), (5, "<article><p>" + "long text " * 20000, "t", 5), (5, "<div class='ad'>unclosed", "t", 6)], "page_id long, html string, text string, n_chars int")
    found = {(r["page_id"], r["n_chars"]): r["text"] for r in html_text.extract_column(pages).collect()}
    assert found[1, 0] == found[2, 0] == "" and found[3, 4] == "a\n\nb" and found[5, 199999] == ("long text " * 20000).strip()
    assert html_text.extract_column(pages.where("false")).count() == 0


def test_decontaminate(odd, empty, bench):
    found = decontaminate.contaminated(odd, bench).collect()
    assert {(r["item_id"], r["doc_id"]) for r in found} == {(1, 10)} and len(found) == 1
    assert decontaminate.contaminated(empty, bench).count() == decontaminate.contaminated(odd, bench.where("false")).count() == 0
    kept = decontaminate.clean(odd, bench)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 1 and kept.where("doc_id = 10").count() == 0


def test_urls(spark):
    rules = {"com/en/": "block", "example.com/en/7": "allow"}
    urls = [None, "", "nothing", "http://EXAMPLE.com/en/71?x", "http://a.com/en/", "http://acom/en/", "http://com", "http://b.org#x", "x" * 100_000, "http://b.org#x"]
    pages = spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    model = url_filter.fit(url_filter.labelled_by(pages, rules))
    found = {r["page_id"]: r for r in url_filter.judge(pages, rules, model).collect()}
    assert len(found) == len(urls) and {r["verdict"] for r in found.values()} <= {"allow", "block"}
    assert [found[k]["host"] for k in (0, 2, 3, 6, 7)] == ["", "", "example.com", "com", "b.org"]
    assert [found[k]["rule"] for k in (3, 4, 5, 6)] == ["example.com/en/7", "com/en/", None, None]
    assert (found[3]["verdict"], found[4]["verdict"], found[4]["path"], found[3]["path"]) == ("allow", "block", "/en/", "/en/71")
    assert url_filter.judge(pages.where("false"), rules, url_filter.fit(pages.where("false").withColumn("accepted", F.lit(True)))).count() == 0


def test_chat(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, 1, "bob", None), (1, None, "system", "s"), (2, 0, "system", "alone"), (None, 0, None, "x"), (None, 0, None, "x"), (3, 0, "ann", LONG)]
    turns = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, content string, start int")
    found = chat.rotate(turns)
    assert found.where("conv_id = 1").count() == 8 and found.where("conv_id = 2").count() == 0
    none = found.where("conv_id is null").orderBy("position").collect()
    assert [r["position"] for r in none] == [0, 1] and none[0]["perspective"] == "unknown" and none[1]["start"] == len(none[0]["content"])
    assert chat.rotate(turns.where("false")).count() == 0


def test_near_duplicates(odd, empty):
    found = {r["doc_id"]: r for r in near_duplicates.links(odd).collect()}
    assert set(found) == set(range(len(TEXTS)))
    assert found[7]["class_id"] == 6 and found[7]["n_links"] == 1 and found[6]["copies"] == 2
    assert all(found[k]["n_links"] == 0 and found[k]["class_id"] == k for k in (0, 1, 2))
    assert near_duplicates.links(empty).count() == 0
    kept = near_duplicates.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [k for k in range(len(TEXTS)) if k != 7]
    assert kept.where("doc_id is null").count() == 1


def test_fingerprints(odd, empty, spark):
    found = fingerprint.edited(odd).collect()
    assert len(found) == odd.count() and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    by = {}
    for r in fingerprint.fingerprints(odd).collect():
        by.setdefault(r["text"] or "", set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by)
    assert fingerprint.edited(empty).count() == 0
    alone = fingerprint.edited(spark.createDataFrame([(5, "one two three four")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1 and alone["n_chars"] == 18


def test_licenses(odd, empty, spark):
    assert licenses.scan(odd).count() == licenses.scan(empty).count() == 0
    docs = spark.createDataFrame([(1, "x y z. " + LONG + " Released under the MIT License. more"), (None, "Released under the MIT license!"), (3, "Released under the"), (1, "Released under the MIT License.")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["license"]) for r in licenses.scan(docs).collect()) == [(0, "MIT"), (1, "MIT"), (1, "MIT")]


def test_pipeline_stages(spark, odd, empty, labels, bench, tmp_path):
    folder = str(tmp_path / "sf")
    labels.write.parquet(f"{folder}/labels.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, folder).columns == docs.columns
            stage(spark, docs, folder).count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= 0
