"""Order statistics, cells, the inverted file and transforms of long series: against brute force, with bounds so small that every step is taken."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import aggregates as A
from statloom.operators import cells, inverted, selection, signal, similarity

SHARES = (0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0)


def groups(seed):
    """Groups of all distinct values, of few values, of one, of two that are many, of a hot and a tiny size, with infinity, and null."""
    rng = np.random.default_rng(seed)
    return {
        "hot": rng.standard_normal(6000) * 10.0 ** rng.integers(-200, 200, 6000),
        "flags": np.repeat([0.0, 1.0], [1500, 1500]),
        "ties": np.concatenate([np.zeros(900), np.ones(900), rng.uniform(0, 1, 200), [0.0] * 100]),
        "one": np.full(800, 7.5),
        "tiny": np.array([3.0, -1.0]),
        "single": np.array([-0.0]),
        "endless": np.array([1.0, np.inf, 2.0]),
        "wrong": np.array([1.0, np.nan, 2.0]),
        None: rng.integers(0, 50, 1000).astype(float),
    }


@pytest.mark.parametrize("bound, grid", [(1 << 18, 512), (300, 16)])
def test_order_statistics(spark, monkeypatch, bound, grid):
    monkeypatch.setattr(selection, "BOUND", bound)
    monkeypatch.setattr(selection, "GRID", grid)
    held = groups(bound)
    rows = [(g, float(x)) for g, values in held.items() for x in values] + [("tiny", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    found = {r["g"]: r for r in selection.order_statistics(df, "x", SHARES, ("g",)).collect()}
    assert found.keys() == held.keys()
    for g, values in held.items():
        assert found[g]["n"] == len(values) and found[g]["fine"] == bool(np.isfinite(values).all())
        if np.isfinite(values).all():
            assert found[g]["values"] == pytest.approx(np.quantile(values, SHARES).tolist(), rel=1e-9, abs=1e-300)
        else:
            assert found[g]["values"] == [None] * len(SHARES)


@pytest.mark.parametrize("bound", [1 << 18, 50])
def test_order_statistics_of_whole_tables(spark, monkeypatch, bound):
    monkeypatch.setattr(selection, "BOUND", bound)
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).cast("double").alias("x"))
    assert A.quartiles_by(df, "x").first().asDict() == {"min": 0, "q1": 249.75, "median": 499.5, "q3": 749.25, "max": 999, "iqr": 499.5}
    assert A.percentiles(df, "x", p=10, outside=101).first().asDict() == {"p": pytest.approx(99.9), "outside": None}
    assert A.percentile_interval_of(df, "x", 0.9).first().asDict() == pytest.approx({"lower": 49.95, "upper": 949.05})
    nothing = selection.order_statistics(df.where("x < 0"), "x", [0.5]).first()
    assert (nothing["n"], nothing["fine"], nothing["values"]) == (0, True, [None])
    assert A.column_summary(df.where("x = 1"), "x").count() == 0


def test_no_percentile_aggregate(spark, data):
    from statloom.plans import catalogue

    for name in ("event_summary", "quartiles_part_price", "percentile_list", "bowley_report", "frame_summary", "percentile_ci"):
        assert "percentile(" not in catalogue.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()


def clustered(rng, n, size, centres):
    x = centres[rng.integers(0, len(centres), n)] + 0.15 * rng.standard_normal((n, size))
    x[n // 2 :] = x[: n - n // 2] + rng.choice([0.0, 1e-3, 0.05], (n - n // 2, 1)) * rng.standard_normal((n - n // 2, size))
    x[3] = 0
    return x


@pytest.mark.parametrize("kind, threshold", [("clusters", 0.999), ("clusters", 0.5), ("isotropic", 0.95), ("isotropic", -0.2), ("equal", 0.95)])
def test_similar_pairs(spark, monkeypatch, threshold, kind):
    """Many small cells and blocks; a hot cell of equal vectors; every pair once, and none lost at a cell's edge."""
    monkeypatch.setattr(cells, "BLOCK", 16)
    rng = np.random.default_rng(3)
    x = clustered(rng, 260, 8, rng.standard_normal((9, 8)) if kind == "clusters" else np.zeros((1, 8)))
    if kind == "equal":
        x[:90] = x[0]
        x[3] = 0
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 8)], "id long, v array<double>").repartition(5)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    product = u @ u.T
    found = [tuple(r) for r in similarity.find_duplicates(df, "v", "id", threshold).collect()]
    got = {(i, j): s for i, j, s in found}
    assert len(got) == len(found) and all(i < j for i, j in got)
    sure = {(i, j) for i in range(260) for j in range(i + 1, 260) if product[i, j] > threshold + 1e-9 and 3 not in (i, j)}
    assert sure <= got.keys() and all(3 not in p and product[p] > threshold - 1e-9 and s == pytest.approx(product[p]) for p, s in got.items())


def test_similar_pairs_of_odd_tables(spark):
    kind = "id string, v array<double>"
    assert similarity.find_duplicates(spark.createDataFrame([], kind), "v", "id").count() == 0
    assert similarity.find_duplicates(spark.createDataFrame([("a", [0.0, 0.0]), ("b", None)], kind), "v", "id").count() == 0
    assert [tuple(r) for r in similarity.find_duplicates(spark.createDataFrame([("b", [1.0]), ("a", [2.0]), ("a", [3.0])], kind), "v", "id").collect()] == [("a", "b", 1.0)] * 2
    with pytest.raises(ValueError, match="length"):
        similarity.find_duplicates(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], kind), "v", "id")


def test_few_pairs_are_multiplied():
    """At 0.95, heads rule out nine tenths of the pairs of vectors without any structure."""
    x = np.random.default_rng(1).standard_normal((1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axes = cells.head(x, 0.95)
    bound = cells.bounded(x, axes) @ cells.bounded(x, axes).T
    upper = np.triu_indices(1000, 1)
    assert axes.shape[1] <= 32 and np.mean(bound[upper] >= 0.95) < 0.1
    assert (bound[upper] >= (x @ x.T)[upper] - 1e-9).all()


@pytest.mark.parametrize("structured", [True, False])
def test_inverted_file(spark, monkeypatch, tmp_path, structured):
    monkeypatch.setattr(cells, "BLOCK", 16)
    monkeypatch.setattr(inverted, "BLOCK", 16)
    rng = np.random.default_rng(4)
    x = clustered(rng, 300, 6, rng.standard_normal((12, 6)) * 3 if structured else np.zeros((1, 6)))
    x[250:] = x[10]  # ties, which go by position
    entries = spark.createDataFrame([(k, f"l{k % 7}", v.tolist()) for k, v in enumerate(x)] + [(999, "none", None)], "position long, label string, vector array<double>")
    index = inverted.InvertedFile.build(entries, f"{tmp_path}/index")
    assert index.count() == 300
    asked = [(k, x[k].tolist()) for k in range(0, 300, 9)] + [(1000, [0.0] * 6), (1001, None), (1002, [1.0])]
    queries = spark.createDataFrame(asked, "q long, v array<double>")
    u = x / np.where(np.linalg.norm(x, axis=1) > 0, np.linalg.norm(x, axis=1), 1)[:, None]
    for k in (1, 7, 400):
        found = {}
        for r in inverted.InvertedFile.load(spark, f"{tmp_path}/index").search(queries, "q", "v", k).orderBy("query", "rank").collect():
            found.setdefault(r["query"], []).append((r["position"], r["label"], r["score"]))
        assert found.keys() == {q for q, v in asked if q < 1001}
        for q, v in asked[:-2]:
            norm = np.linalg.norm(v) or 1
            score = u @ (np.array(v) / norm)
            want = sorted(range(300), key=lambda i: (-round(score[i], 12), i))[:k]
            assert [p for p, _, _ in found[q]] == want or np.allclose([score[p] for p, _, _ in found[q]], score[want], atol=1e-12)
            assert [s for _, _, s in found[q]] == pytest.approx(score[want].tolist(), abs=1e-12)
            assert all(label == f"l{p % 7}" for p, label, _ in found[q])
    r = index.retrieve(queries.where("q = 9"), "q", "v", 3).first()
    score = u @ u[9]
    assert (r["mean"], r["deviation"], r["top_score"]) == pytest.approx((score.mean(), score.std(ddof=1), score.max()))
    assert r["top_z"] == pytest.approx((score.max() - score.mean()) / score.std(ddof=1)) and len(r["hits"]) == 3
    if structured:  # far cells are not read
        visits = index._visited(index._asked(queries, "q", "v"), 5, False).count()
        assert visits < 0.7 * 34 * (index.sizes > 0).sum()


def test_inverted_file_of_nothing(spark, tmp_path):
    index = inverted.InvertedFile.build(spark.createDataFrame([], "position long, label string, vector array<double>"), f"{tmp_path}/none")
    assert index.count() == 0 and index.search(spark.createDataFrame([(1, [1.0])], "q long, v array<double>"), "q", "v", 3).count() == 0
    zeros = inverted.InvertedFile.build(spark.createDataFrame([(1, "a", [0.0, 0.0])], "position long, label string, vector array<double>"), f"{tmp_path}/zeros")
    assert [tuple(r)[:3] for r in zeros.search(spark.createDataFrame([(1, [1.0, 0.0])], "q long, v array<double>"), "q", "v", 3).collect()] == [(1, 1, 1)]


@pytest.mark.parametrize("n, group", [(1, 1 << 18), (2, 1), (4, 1 << 18), (8, 4), (128, 1), (2048, 64), (4096, 1 << 18)])
def test_six_steps(spark, monkeypatch, n, group):
    monkeypatch.setattr(signal, "GROUP", group)
    x = np.random.default_rng(n).standard_normal(n)
    df = spark.createDataFrame([(k * 3 + 5, float(v)) for k, v in enumerate(x)], "t long, x double").repartition(3)
    found = sorted(signal.fourier(df, "x", "t").collect())
    want = np.fft.fft(x)
    assert [r["bin"] for r in found] == list(range(n))
    assert np.allclose([r["magnitude"] for r in found], np.abs(want)) and np.allclose(np.exp(1j * np.array([r["phase"] for r in found])), np.exp(1j * np.angle(want)))
    back = sorted(signal.fourier_inverse(df.withColumn("t", (F.col("t") - 5) / 3), "x", "t").collect())
    assert np.allclose([r["value"] for r in back], np.fft.ifft(x).real)


@pytest.mark.parametrize("n, windowed", [(0, False), (1, True), (2, True), (3, True), (5, False), (100, False), (100, True)])
def test_spectra_of_whole_tables(spark, n, windowed):
    x = np.random.default_rng(n).standard_normal(n)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "t long, x double")
    f, m = signal.spectrum(x, 50.0, windowed) if n else (np.zeros(0), np.zeros(0))
    found = sorted(signal.fourier_spectrum(df, "x", "t", 50.0, windowed).collect())
    assert np.allclose([r["frequency"] for r in found], f) and np.allclose([r["magnitude"] for r in found], m)
    want = signal.power_spectral_density(x, 50.0, windowed)
    found = sorted(signal.density(df, "x", "t", 50.0, windowed).collect(), key=lambda r: r["bin"])
    densities = [] if want is None else [float(v) if np.isfinite(v) else None for v in want.densities]
    assert [r["density"] is None for r in found] == [v is None for v in densities]
    assert np.allclose([r["density"] or 0 for r in found], [v or 0 for v in densities])


def test_transform_of_a_wrong_size(spark):
    with pytest.raises(ValueError, match="power of two"):
        signal.fourier(spark.range(3).select("id", F.lit(1.0).alias("x")), "x", "id")


@pytest.mark.parametrize("block", [1 << 16, 40])
def test_series_of_one_hot_group(spark, monkeypatch, block):
    """A group that holds nearly all rows goes over many blocks; its neighbours are short, and one has no name."""
    from statloom import core
    from statloom.operators import series as S

    monkeypatch.setattr(core, "BLOCK", block)
    rng = np.random.default_rng(2)
    held = {"hot": rng.uniform(0.5, 1.5, 700), "short": rng.uniform(0.5, 1.5, 30), None: rng.uniform(0.5, 1.5, 55), "one": np.array([2.0])}
    rows = [(g, k * 7 + len(str(g)), float(x)) for g, values in held.items() for k, x in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, t long, x double").repartition(4)
    by = ("g",)

    def series(made, name):
        out = {}
        for r in made.orderBy("t").collect():
            out.setdefault(r["g"], []).append(r[name])
        return out

    def smoothed(v):
        out = [v[0]]
        for x in v[1:]:
            out.append(0.2 * x + 0.8 * out[-1])
        return out

    rolling = lambda v: [np.mean(v[max(0, k - 49) : k + 1]) if len(v) >= 50 else np.mean(v) for k in range(len(v))]
    for made, name, want in (
        (S.cumulative_sum(df, "x", "t", by), "cumulative", np.cumsum),
        (S.cumulative_product(df, "x", "t", by), "cumulative", np.cumprod),
        (S.rolling_mean(df, "x", "t", 50, by), "rolling", rolling),
        (S.exponential_mean(df, "x", "t", alpha=0.2, by=by), "smoothed", smoothed),
        (S.diff(df, "x", "t", 3, by), "diff", lambda v: v[3:] - v[:-3]),
        (S.percent_change(df, "x", "t", 1, by), "change", lambda v: (v[1:] / v[:-1] - 1) * 100),
        (S.cumulative_trapezoidal(df, "x", "t", 0.5, by), "integral", lambda v: np.concatenate([[0], np.cumsum((v[1:] + v[:-1]) / 4)])),
    ):
        found = series(made, name)
        for g, values in held.items():
            assert np.allclose(found.get(g, []), want(values), rtol=1e-9), (name, g)
    if block == 40:
        plan = S.cumulative_sum(df, "x", "t", by)._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if line.strip(" :+-").startswith("Window")]
        assert windows and all("_place_" in w or "_prefix_" in w for w in windows)
    assert S.cumulative_sum(df.withColumn("t", F.lpad(F.col("t").cast("string"), 9, "0")), "x", "t", by).count() == len(rows)


def test_array_forms_of_distributions():
    """The array forms are the functions of numbers, also where those are undefined."""
    from statloom.functions import distributions as D

    rng = np.random.default_rng(6)
    grids = {
        D.normal_cdf: [rng.normal(0, 3, 200), rng.normal(0, 1, 200), rng.uniform(-0.2, 3, 200)],
        D.chi_squared_cdf: [rng.uniform(-2, 60, 400), rng.uniform(-1, 40, 400)],
        D.t_cdf: [np.append(rng.normal(0, 3, 399), 0.0), rng.uniform(-0.5, 30, 400)],
        D.poisson_pmf: [rng.integers(-2, 60, 300).astype(float), rng.uniform(-1, 40, 300)],
        D.poisson_cdf: [rng.integers(-2, 60, 300).astype(float), rng.uniform(-1, 40, 300)],
        D.binomial_pmf: [rng.integers(-1, 20, 400).astype(float), rng.integers(0, 20, 400).astype(float), np.append(rng.uniform(-0.1, 1.1, 396), [0, 1, 0, 1])],
        D.binomial_cdf: [rng.integers(-1, 20, 400).astype(float), rng.integers(0, 20, 400).astype(float), np.append(rng.uniform(-0.1, 1.1, 396), [0, 1, 0, 1])],
    }
    assert grids.keys() == D.ARRAYS.keys()
    for f, columns in grids.items():
        defined, whole = D.ARRAYS[f]
        with np.errstate(all="ignore"):
            found = D._where(defined(*columns), whole, *columns)
        for got, *row in zip(found, *columns):
            want = f(*(int(v) if f in (D.poisson_pmf, D.binomial_pmf, D.binomial_cdf, D.poisson_cdf) and k < (1 if f in (D.poisson_pmf, D.poisson_cdf) else 2) else v for k, v in enumerate(row)))
            assert (np.isnan(got) and want is None) or got == pytest.approx(want, rel=1e-9, abs=1e-12), (f.__name__, row)


def test_array_forms_of_quantiles(spark):
    """As the functions of numbers, also in far tails, at the ends and where undefined; and as closed forms, without a call for each value."""
    from statloom.functions import distributions as D

    rng = np.random.default_rng(8)
    p = np.concatenate([rng.uniform(0, 1, 200), 10.0 ** -rng.uniform(1, 13, 60), 1 - 10.0 ** -rng.uniform(1, 13, 60), [0.5, 0.2, 0.8, 0.0, 1.0, -0.1, 1.1, math.nan]])
    cases = [(D.t_quantile, (df,)) for df in (0.1, 1.0, 2.0, 7.5, 300.0, -1.0)] + [(D.poisson_quantile, (r,)) for r in (0.3, 3.5, 90.0, 0.0)]
    cases += [(D.binomial_quantile, (n, q)) for n, q in ((10, 0.4), (0, 0.3), (10, 0.0), (10, 1.0), (200, 0.01), (10, 1.5))]
    for f, fixed in cases:
        defined, whole = D.QUANTILES[f]
        columns = [p, *(np.full(len(p), float(v)) for v in fixed)]
        with np.errstate(all="ignore"):
            found = D._where(defined(*columns), whole, *columns)
        for got, x in zip(found, p):
            want = f(float(x), *fixed)
            assert (np.isnan(got) and want is None) or got == pytest.approx(want, rel=1e-10, abs=1e-11), (f.__name__, fixed, x)
    q = np.concatenate([np.arange(1, 40) / (1 << 23), np.arange(1, 64) / 64, 0.5 + np.arange(-9, 10) / (1 << 23)])
    closed = (2 * q - 1) / np.sqrt(2 * q * (1 - q))
    with np.errstate(all="ignore"):
        assert np.allclose(D._t_quantile_array(q, np.full(len(q), 2.0)), closed, rtol=1e-11, atol=1e-12)
    assert [D.t_quantile(float(x), 2) for x in q] == pytest.approx(closed.tolist(), rel=1e-11, abs=1e-11)
    df = spark.createDataFrame([(float(x),) for x in q] + [(None,)], "p double")
    assert [r[0] for r in df.select(D.column(D.t_quantile, 2)("p")).collect()] == [*map(pytest.approx, closed), None]


def test_ranked(spark):
    """Texts, descending numbers, nulls, NaN and one value that all rows share but for a second column; positions are without gaps."""
    from statloom.operators import frame

    rng = np.random.default_rng(7)
    rows = [(k, rng.choice(["b", "a", None]), float(rng.choice([1.0, 2.0, float("nan")])), "hot") for k in range(500)]
    df = spark.createDataFrame(rows, "k long, s string, x double, h string").repartition(7)
    found = frame.ranked(df, "s", F.desc("x"), "k", name="at").orderBy("at").collect()
    place = {None: 0, "a": 1, "b": 2}
    want = sorted(rows, key=lambda r: (place[r[1]], 0 if r[2] != r[2] else -r[2] + 3, r[0]))
    assert [r["at"] for r in found] == list(range(500)) and [r["k"] for r in found] == [r[0] for r in want]
    hot = frame.ranked(df, "h", "k")
    assert [tuple(r) for r in hot.select("k", "position").orderBy("k").collect()] == [(k, k) for k in range(500)]
    assert frame.ranked(df.where("k < 0"), "h").count() == 0
    assert sorted(r["position"] for r in frame.ranked(df, "h").collect()) == list(range(500))


def test_rolling_window_larger_than_n_of_more_suppliers(spark, tmp_path):
    """The window grows with the table, and a window that no series fills is an aggregate; one that only some fill is rolled for these."""
    from statloom.operators import series as S
    from statloom.plans import catalogue

    suppliers = spark.range(6000).select(F.col("id").alias("s_suppkey"), (F.col("id") % 97).cast("double").alias("s_acctbal"))
    suppliers.repartition(3).write.parquet(f"{tmp_path}/supplier.parquet")
    made = catalogue.QUERIES["rolling_window_larger_than_n"](spark, str(tmp_path))
    assert {r["rolling"] for r in made.collect()} == {round(sum(k % 97 for k in range(6000)) / 6000, 6)} and made.count() == 6000
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString()
    groups = spark.range(1600).select("id", F.when(F.col("id") < 1300, "long").alias("g"), F.col("id").cast("double").alias("x"))
    found = {r["id"]: r["rolling"] for r in S.rolling_mean(groups, "x", "id", 1200, ("g",)).collect()}
    assert len(found) == 1600 and found[1299] == np.mean(range(100, 1300)) and found[0] == 0 and {found[k] for k in range(1300, 1600)} == {1449.5}
    assert {r["rolling"] for r in S.rolling_mean(groups, "x", "id", 1400, ("g",)).collect()} == {649.5, 1449.5}
