"""Saved models, starts of k-means, bounds, and small conventions."""

import math
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statloom.functions import text
from statloom.functions.polynomials import format_number
from statloom.models import kmeans, linear
from statloom.models.neighbours import KNearestNeighbours
from statloom.models.pipeline import Pipeline
from statloom.models.scaling import FeatureScaler, StandardScaler
from statloom.operators import groups, sampling, signal, similarity


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    data = [(k, [float(x) for x in rng.normal(k % 3 * 2, 1, 3)], k % 3, float(k)) for k in range(90)]
    return spark.createDataFrame(data, "id long, x array<double>, label int, y double").persist()


def shuffled(n, k, seed):
    """Fisher and Yates' shuffle, step by step."""
    places, state = list(range(n)), seed
    for i in range(n - 1, 0, -1):
        state = (state * kmeans.LCG_FACTOR + kmeans.LCG_STEP) % (1 << 64)
        j = state % (i + 1)
        places[i], places[j] = places[j], places[i]
    return places[:k]


@pytest.mark.parametrize("draws", [1, 7, 64, 1 << 20])
def test_first_places_of_a_shuffle(monkeypatch, draws):
    monkeypatch.setattr(kmeans, "DRAWS", draws)
    rng = random.Random(draws)
    for _ in range(60):
        n = rng.randint(1, 150)
        k, seed = rng.randint(1, n), rng.randrange(1 << 40)
        assert kmeans.initial_rows(n, k, seed) == shuffled(n, k, seed)


def test_k_means_members_and_best_fit(rows):
    model = kmeans.KMeans.best_fit(rows, "x", 3, "id", 20, attempts=3)
    assert model.inertia == min(kmeans.KMeans.fit(rows, "x", 3, "id", 20, seed).inertia for seed in range(3))
    members = model.members(rows, "x")
    assert members.agg(F.sum("distance")).first()[0] == pytest.approx(model.inertia)
    sizes = {r["cluster"]: r["size"] for r in model.clusters(rows, "x").collect()}
    assert {r["cluster"]: r["n"] for r in members.groupBy("cluster").agg(F.count("*").alias("n")).collect()} == sizes
    assert kmeans.KMeans.from_json(model.to_json()) == model


def test_saved_pipelines(spark, rows, tmp_path):
    made = {
        "bayes": Pipeline.naive_bayes(rows, "x", "label"),
        "linear": Pipeline.linear(rows, "x", "y"),
        "k_means": Pipeline.k_means(rows, "x", 2, "id"),
        "neighbours": Pipeline.nearest_neighbours(rows, "id", "x", "label", k=3),
    }
    for name, pipeline in made.items():
        pipeline.save(str(tmp_path / name), spark)
        again = Pipeline.load(str(tmp_path / name), spark)
        assert again.scaler == pipeline.scaler
        if name == "neighbours":
            assert sorted(map(tuple, again.predict(rows, "x", id="id").collect())) == sorted(map(tuple, pipeline.predict(rows, "x", id="id").collect()))
        else:
            assert again.model == pipeline.model and again.predict(rows, "x").exceptAll(pipeline.predict(rows, "x")).isEmpty()


def test_saved_scalers_and_neighbours(spark, rows, tmp_path):
    for scaler in (StandardScaler.fit(rows, "x"), FeatureScaler.fit(rows, "x", -1, 1)):
        assert type(scaler).from_json(scaler.to_json()) == scaler
    model = KNearestNeighbours.fit(rows, "id", "x", "label", 5, "cosine", "distance")
    model.save(str(tmp_path / "knn"))
    scaler.save(str(tmp_path / "scaler"), spark)
    assert FeatureScaler.load(str(tmp_path / "scaler"), spark) == scaler
    with pytest.raises(ValueError, match="length"):
        model.neighbours(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, x array<double>"), "id", "x")
    again = KNearestNeighbours.load(spark, str(tmp_path / "knn"))
    assert (again.k, again.metric, again.weight) == (5, "cosine", "distance") and again.train.count() == 90


def test_index_by_text(spark):
    entries = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0])], "position long, label string, vector array<double>")
    index = similarity.EmbeddingIndex(entries, lambda t: F.when(F.length(t) > 0, F.array(F.length(t).cast("double"), F.lit(1.0))))
    assert index.retrieve("long text", 1).first()["hits"][0]["label"] == "a"
    refused = index.retrieve("", 1).first()
    assert refused["hits"] == [] and refused["top_score"] == 0
    assert list(index) == [("a", [1.0, 0.0]), ("b", [0.0, 1.0])] and index.contains("b") and not index.contains("c")


def test_oversampling_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BLOCK", 4)
    df = spark.createDataFrame([(k, "ab"[k % 10 == 0], [float(k), 1.0]) for k in range(60)], "id long, label string, x array<double>")
    made = sampling.oversample(df, "id", "label", "x", 3).collect()
    own = [r["x"] for r in made if r["label"] == "b"]
    assert len(own) == len([r for r in made if r["label"] == "a"]) == 54
    real = [[10.0 * k, 1.0] for k in range(6)]
    assert sorted(r["x"] for r in made if r["label"] == "b" and not r["synthetic"]) == real
    assert all(x[1] == 1.0 and 0 <= x[0] <= 50 for x in own)


def test_bounds(spark, monkeypatch):
    df = spark.range(100).select("id", F.col("id").alias("x"))
    with pytest.raises(ValueError):
        groups.contingency(df, "id", "x", 9999)
    assert groups.contingency(df, "id", "x", 10_000).count() == 10_000
    monkeypatch.setattr(signal, "GROUP", 4)  # a series has no bound: its blocks have
    assert signal.fourier(df.where("id < 64"), "x", "id").agg(F.max("bin")).first()[0] == 63
    with pytest.raises(ValueError):
        signal.fourier(df, "x", "id")


def test_numbers_as_text():
    found = [format_number(x) for x in (2.00001, 2.0, 0.99999, -0.0, 1.5, 12.34567, 1e-5, float("inf"), float("-inf"), float("nan"))]
    assert found == ["2.0000", "2", "1.0000", "0", "1.5", "12.3457", "1e-05", "∞", "-∞", "NaN"]


def test_descent_goes_on_where_the_loss_rises_by_less_than_the_tolerance():
    losses = iter([1.0, 1.0 + 1e-9, 0.5, 0.5])
    assert linear.descend(np.zeros(1), lambda w: next(losses), lambda w: w, 0.1, 10, 1e-6)[1:] == ([1.0, 1.0 + 1e-9, 0.5, 0.5], linear.CONVERGED)


def test_tokens_against_stripping_each(spark):
    import regex

    texts = ["Hello, world! It's (really) fine...", " -- a--b ,c, «d» \"e\"", "...", "", "a,,,,b ,,,", " x (y)\t[z]\n", "!?" * 3000 + "a"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", text.tokenize("t").alias("w"), text.tokenize("t", False).alias("r")).orderBy("k").collect()
    for row, t in zip(got, texts):
        raw = [w for w in regex.split(r"[\s\p{Z}\x85]+", t.lower()) if w]
        assert row["r"] == raw
        assert row["w"] == [w for w in (regex.sub(r"^\p{P}+|\p{P}+$", "", x) for x in raw) if w]


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_neighbours_against_all_distances(spark, monkeypatch, metric):
    """With copies, zeros, a null, a NaN and a vector of another length; in one tile and block, and in many."""
    draw = np.random.default_rng(3)
    vectors = [[float(x) for x in v] for v in draw.integers(-2, 3, (120, 4))]
    vectors[10:40] = [vectors[10]] * 30
    vectors[50], vectors[60], vectors[70], vectors[80] = [0.0] * 4, [1.0, math.nan, 0.0, 0.0], None, [1.0]
    rows = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(vectors)], "id long, x array<double>, label int").repartition(5)
    asked = rows.where("id % 7 = 0 or id = 60")

    def distance(a, b):
        if metric == "euclidean":
            return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))
        norms = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(y * y for y in b))
        return max(1 - sum(x * y for x, y in zip(a, b)) / (norms[0] * norms[1]), 0.0) if all(norms) else 1.0

    fine = {i: v for i, v in enumerate(vectors) if v is not None and len(v) == 4}
    want = {}
    for q in [i for i in fine if i % 7 == 0]:
        # rounded, so that ties are ties however they are added up; cosine's order within 1e-12 isn't compared
        near = sorted((math.inf if math.isnan(d := distance(fine[q], v)) else round(d, 9), i) for i, v in fine.items())
        want[q] = [d for d, _ in near[:6]], [i for _, i in near[:6]]
    for tile, block in ((1 << 17, 64 << 20), (64, 200)):
        monkeypatch.setattr("statloom.models.neighbours.TILE", tile)
        monkeypatch.setattr("statloom.models.neighbours.BLOCK_BYTES", block)
        got = KNearestNeighbours.fit(rows, "id", "x", "label", 6, metric).neighbours(asked, "id", "x").collect()
        for q, (distances, ids) in want.items():
            own = sorted((r["distance"], r["neighbour"]) for r in got if r["query"] == q)
            assert [round(d, 9) for d, _ in own] == distances
            assert metric == "cosine" or [i for _, i in own] == ids
        assert {r["query"] for r in got} == {*want, 60} and sum(r["query"] == 60 for r in got) == 6
    assert KNearestNeighbours.fit(rows, "id", "x", "label", 6, metric).neighbours(asked.where("id < 0"), "id", "x").collect() == []


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("tile", [1 << 18, 64])
def test_a_task_gives_the_k_nearest_only(monkeypatch, metric, tile):
    """Of any number of copies and queries, over many batches: the first k by distance and id, whose order is that of texts here."""
    from statloom.models import neighbours as N

    monkeypatch.setattr(N, "TILE", tile)
    draw = np.random.default_rng(9)
    rows = np.concatenate([np.repeat(draw.standard_normal((3, 8)), 150, axis=0), draw.standard_normal((150, 8)), 1e6 * draw.standard_normal((5, 8))])
    if metric == "cosine":
        rows /= np.sqrt((rows**2).sum(1, keepdims=True))
    ids = [str(k) for k in draw.permutation(len(rows))]
    asked = rows[::9]
    batches = [pa.record_batch({"neighbour": ids[a : a + 40], "label": list(range(len(rows)))[a : a + 40], "b": pa.array(rows[a : a + 40].tolist())}) for a in range(0, len(rows), 40)]
    shipped = SimpleNamespace(value=(pa.array(range(len(asked))), asked))
    found = pa.Table.from_batches(list(N._nearest(shipped, 8, 6, metric)(iter(batches)))).to_pylist()
    assert len(found) == 6 * len(asked)
    for q, own in enumerate(asked):
        total = np.cumsum(rows * own if metric == "cosine" else np.square(rows - own), axis=1)[:, -1]
        distance = np.sqrt(total) if metric == "euclidean" else np.where(1 - total < 1e-12, 0.0, 1 - total)
        want = sorted(zip(distance.tolist(), ids))[:6]
        assert [(r["distance"], r["neighbour"]) for r in found if r["query"] == q] == want


def test_a_task_holds_k_rows_for_each_query_only():
    """Rows that are all nearer than those before, then copies of one row: what is held doesn't grow with the rows met."""
    from statloom.models import neighbours as N

    asked = np.eye(4)
    near = N._Near(pa.array(range(4)), asked, 7, "cosine")
    for step in range(30):
        rows = np.repeat(asked, 25, axis=0) + 1 / (1 + min(step, 20))
        rows /= np.sqrt((rows**2).sum(1, keepdims=True))
        near.offer(rows, pa.array(range(1000 * step, 1000 * step + 100)), pa.array([0] * 100))
        assert len(near.query) == len(near.distance) == len(near.neighbour) == len(near.label) == 4 * 7
    found = next(near.nearest()).to_pylist()
    assert all(r["neighbour"] // 1000 == 20 and r["neighbour"] % 1000 - 25 * r["query"] in range(7) for r in found)


@pytest.mark.parametrize("blocks", [2, 8])
def test_a_task_sorts_one_share_of_one_block(spark, monkeypatch, blocks):
    """No two blocks or shares come to one task, and the neighbours are those of a single block."""
    from statloom.models import neighbours as N

    draw = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(draw.standard_normal((400, 4)).tolist())], "id long, x array<double>, label int")
    asked = df.where("id % 2 = 0")
    dealt = N._met(asked.selectExpr("id as query", "x as a"), df.selectExpr("id as neighbour", "label", "x as b"), blocks)
    tasks = dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count_distinct("block", "share").alias("pairs")).collect()
    assert len(tasks) >= blocks and {r["pairs"] for r in tasks} == {1} and sum(r["n"] for r in tasks) >= 400 * blocks + 200
    model, found = KNearestNeighbours.fit(df, "id", "x", "label", 5), []
    for block in (64 << 20, 200 * 64 // blocks):
        monkeypatch.setattr(N, "BLOCK_BYTES", block)
        found.append(sorted(map(tuple, model.neighbours(asked, "id", "x").collect())))
    assert found[0] == found[1] and len(found[0]) == 5 * 200


def test_tokens_against_a_split_by_characters(spark):
    """Punctuation goes at the ends of tokens only; a long run of it within a token takes no quadratic time."""
    space, draw = " \t\n\u0085 　", random.Random(5)
    texts = ["".join(draw.choice("ab.-(" + space) for _ in range(draw.randrange(12))) for _ in range(400)]
    texts += ["a" + "." * 200_000 + "b", "." * 200_000, " ." * 50_000, "a -- b", "x!\n", ""]

    def tokens(t):
        words = "".join(" " if c in space else c for c in t.lower()).split(" ")
        return [w for w in (w.strip(".-(!") for w in words) if w]

    df = spark.createDataFrame([*((t,) for t in texts), (None,)], "t string")
    got = [r[0] for r in df.select(text.tokenize("t")).collect()]
    assert got == [*map(tokens, texts), None]
