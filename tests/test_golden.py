"""Published and hand-calculated values, and invariants."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statloom.functions import bayes, distributions as D, linalg, text
from statloom.functions import vectors as V
from statloom.functions.fractions import Fraction, as_fractions
from statloom.functions.polynomials import Polynomial, polyfit
from statloom.models.bayes import GaussianNaiveBayes
from statloom.models.kmeans import KMeans, initial_rows
from statloom.models.linear import Diverged, GradientDescent, LinearRegression, LogisticRegression, Ridge
from statloom.models.neighbours import KNearestNeighbours
from statloom.models.scaling import StandardScaler
from statloom.operators import aggregates as A, cells
from statloom.operators import correlation, frame, groups, histograms, metrics, sampling, series, signal, similarity


def rows(spark, values, name="x"):
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in enumerate(values)], f"position long, {name} double")


def one(df):
    return df.first()[0]


def agg(spark, values, column):
    return one(rows(spark, values).agg(column))


class TestAggregates:
    def test_basic(self, spark):
        assert agg(spark, [1, 2, 3, 4, 5], A.variance("x")) == 2.5
        assert agg(spark, [5, 3, 8, 1, 7], A.arg_min("x", "position")) == 3
        assert agg(spark, [5, 8, 8, 1, 7], A.arg_max("x", "position")) == 1
        assert agg(spark, [], A.product("x")) == 0
        assert agg(spark, [], A.total("x")) == 0
        assert agg(spark, [5], A.standard_deviation("x")) is None

    def test_shape(self, spark):
        x = [1, 1, 1, 1, 2, 10]
        assert agg(spark, x, A.skewness("x")) == pytest.approx(1.7419977554012613)
        assert agg(spark, x, A.kurtosis("x")) == pytest.approx(1.1089129529362767)
        assert agg(spark, range(1, 11), A.kurtosis("x")) == pytest.approx(-1.2242424242424244)
        assert agg(spark, [50, 55, 58, 60, 62, 180], A.skewness("x", bias=False)) == pytest.approx(2.4109114412)
        assert agg(spark, [1, 2, 3, 4, 5, 20, 40, 60], A.bowley_skewness("x")) == pytest.approx(0.8426966292)
        report = A.skewness_report(rows(spark, [50, 55, 58, 60, 62, 180]), "x").first()
        assert report["agreement"] == "direction"

    @pytest.mark.parametrize("bad", [math.nan, math.inf, -math.inf])
    def test_guards(self, spark, bad):
        for f in (A.skewness, A.kurtosis, lambda c: A.percentile(c, 50), A.bowley_skewness):
            assert agg(spark, [1, 2, bad, 4, 7, 9], f("x")) is None
        assert histograms.histogram(rows(spark, [1, 2, bad, 4]), "x", 3).count() == 0

    @pytest.mark.parametrize("values", [[], [3], [3, 3, 3, 3], [None, 1.0, 2.0]])
    def test_edges(self, spark, values):
        df = rows(spark, values)
        assert A.column_summary(df, "x").count() == (len([v for v in values if v is not None]) > 1)
        assert A.empirical_rule(df, "x").count() == 1
        assert A.percentile_ranks(df, "x").count() == len(values)
        assert A.modes(df, "x").count() <= 2
        series.standardized(df, "x").collect()
        series.scaled(df, "x", 0, 1).collect()
        series.as_percentages(df, "x").collect()

    def test_summary(self, spark):
        s = A.column_summary(rows(spark, range(1, 11)), "x").first()
        assert (s["count"], s["mean"], s["q1"], s["median"], s["q3"], s["iqr"]) == (10, 5.5, 3.25, 5.5, 7.75, 4.5)
        assert s["std"] == pytest.approx(3.0276503540974917)

    def test_outliers_and_modes(self, spark):
        found = A.outlier_mask(rows(spark, [4, 7, 2, 9, 3, 35, 5]), "x").where("outlier").collect()
        assert [r["position"] for r in found] == [5]
        assert not A.outlier_mask(rows(spark, [5]), "x").first()["outlier"]
        assert {r["x"] for r in A.modes(rows(spark, [4, 5, 4, 3, 5, 4, 5]), "x").collect()} == {4, 5}

    def test_percentiles(self, spark):
        assert [agg(spark, range(1, 11), A.percentile("x", p)) for p in (0, 50, 100)] == [1, 5.5, 10]
        assert agg(spark, [85, 92, 78, 88, 95], A.percentile_rank(88, "x")) == 50


class TestSeries:
    def test_rolling(self, spark):
        df = rows(spark, [1, 2, 3, 4, 5])
        assert [r["rolling"] for r in series.rolling_mean(df, "x", "position", 3).orderBy("position").collect()] == [1, 1.5, 2, 3, 4]
        assert [r["rolling"] for r in series.rolling_mean(rows(spark, [1, 2, 3]), "x", "position", 10).collect()] == [2, 2, 2]
        assert series.rolling_mean(df, "x", "position", 0).count() == 0

    def test_differences(self, spark):
        df = rows(spark, [10, 12, 11, 13, 15])
        assert [r["diff"] for r in series.diff(df, "x", "position").orderBy("position").collect()] == [2, -1, 2, 2]
        change = [r["change"] for r in series.percent_change(rows(spark, [100, 120, 110, 130]), "x", "position").orderBy("position").collect()]
        assert change == pytest.approx([20, -8.333333, 18.181818], abs=1e-5)

    def test_integrals(self, spark):
        assert one(series.trapezoidal_integral(rows(spark, [250] * 10), "x", "position", 1)) == 2250
        assert [r["integral"] for r in series.cumulative_trapezoidal(rows(spark, [200] * 4), "x", "position", 1).orderBy("position").collect()] == [0, 200, 400, 600]
        assert one(series.trapezoidal_integral(rows(spark, [250]), "x", "position", 1)) is None

    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.floats(-1e3, 1e3), min_size=1, max_size=60), st.integers(1, 9))
    def test_blocks_are_seamless(self, spark, values, window):
        """The same with blocks of a few rows, whose seams then matter, as in one piece."""
        import statloom.core as core
        import statloom.operators.series as module

        old = core.BLOCK
        core.BLOCK = module.BLOCK = 4
        try:
            df = rows(spark, values)
            get = lambda d, c: [r[c] for r in d.orderBy("position").collect()]
            assert get(series.cumulative_sum(df, "x", "position"), "cumulative") == pytest.approx(np.cumsum(values).tolist(), abs=1e-6)
            want = [np.mean(values[max(0, k - window + 1) : k + 1]) if window <= len(values) else np.mean(values) for k in range(len(values))]
            assert get(series.rolling_mean(df, "x", "position", window), "rolling") == pytest.approx(want, abs=1e-6)
            s, want = values[0], []
            for v in values:
                s = 0.3 * v + 0.7 * s
                want.append(s)
            assert get(series.exponential_mean(df, "x", "position", alpha=0.3), "smoothed") == pytest.approx(want, abs=1e-6)
        finally:
            core.BLOCK = module.BLOCK = old

    def test_histogram(self, spark):
        assert [r["count"] for r in histograms.histogram(rows(spark, range(1, 11)), "x", 5).orderBy("bin").collect()] == [2] * 5
        for rule, n in (("square_root", 10), ("sturges", 8), ("freedman_diaconis", 5)):
            assert histograms.histogram(rows(spark, range(1, 101)), "x", rule).count() == n
        assert [tuple(r)[1:] for r in histograms.histogram(rows(spark, [3] * 5), "x", "sturges").collect()] == [(3.0, 5)]

    def test_correlation_of_constant(self, spark):
        df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "a double, b double")
        found = {(r["x"], r["y"]): r["value"] for r in correlation.correlation_pairs(df, ["a", "b"]).collect()}
        assert found["a", "a"] == found["b", "b"] == 1 and math.isnan(found["a", "b"])
        assert one(correlation.correlation(df, "a", "b")) is None


class TestGroups:
    def test_groups(self, spark):
        df = spark.createDataFrame([("A", 100.0), ("B", 200.0), ("A", 150.0), ("B", 300.0)], "c string, x double")
        assert [tuple(r) for r in groups.grouped_data(df, "c", "x", "sum").collect()] == [("A", 250), ("B", 500)]
        with pytest.raises(ValueError):
            groups.group_by(df, "c", "x", "median")

    def test_contingency(self, spark):
        cells = [("F", "Math", 1), ("F", "English", 17), ("M", "Math", 37), ("M", "English", 20)]
        df = spark.createDataFrame([(r, c) for r, c, n in cells for _ in range(n)], "r string, c string")
        t = groups.contingency(df, "r", "c")
        assert {r["row"]: r["count"] for r in groups.row_totals(t).collect()} == {"F": 18, "M": 57}
        p = {(r["row"], r["column"]): r["probability"] for r in groups.conditional_by_column(t).collect()}
        assert p["M", "Math"] == pytest.approx(37 / 38)
        p = {(r["row"], r["column"]): r["probability"] for r in groups.conditional_by_row(t).collect()}
        assert p["M", "Math"] == pytest.approx(37 / 57)

    def test_sort_nan_last(self, spark):
        df = rows(spark, [72, math.nan, 95, 88])
        for up, want in ((True, [72, 88, 95]), (False, [95, 88, 72])):
            got = [r["x"] for r in frame.sorted_by(df, "x", "position", up).collect()]
            assert got[:3] == want and math.isnan(got[3])

    def test_panel(self, spark):
        df = frame.from_columns(spark, {"b": [1, 2], "a": [3, 4]})
        assert df.columns == ["position", "a", "b"]
        for bad in ([], [("a", [])], [("a", [1]), ("a", [2])], [("a", [1]), ("b", [1, 2])]):
            with pytest.raises(ValueError):
                frame.from_columns(spark, bad)
        with pytest.raises(ValueError):
            frame.select(df, "nothing")
        assert frame.head(df, "position", ["a", "b"], 1).splitlines()[1].split() == ["0", "3.0", "1.0"]


class TestVectors:
    def value(self, spark, c):
        return one(spark.range(1).select(c))

    def test_products(self, spark):
        v = V.literal
        assert self.value(spark, V.dot(v([1, 2, 3]), v([4, 5, 6]))) == 32
        assert self.value(spark, V.magnitude(v([3, 4]))) == 5
        assert self.value(spark, V.vector_projection(v([3, 4]), v([1, 0]))) == [3, 0]
        assert self.value(spark, V.orthogonal_component(v([3, 4]), v([1, 0]))) == [0, 4]
        assert self.value(spark, V.cosine(v([0, 0]), v([1, 0]))) == 0
        assert self.value(spark, V.transpose(v([[1, 2, 3], [4, 5, 6]]))) == [[1, 4], [2, 5], [3, 6]]
        assert self.value(spark, V.matrix_product(v([[1, 2], [3, 4]]), v([[0, 1], [1, 0]]))) == [[2, 1], [4, 3]]
        assert self.value(spark, V.identity(2)) == [[1, 0], [0, 1]]
        assert self.value(spark, V.reshaped(v([1, 2, 3, 4]), 2, 2)) == [[1, 2], [3, 4]]

    def test_errors(self, spark):
        for bad in (V.add(V.literal([1, 2]), V.literal([1])), V.divide(V.literal([1]), V.literal([0])), V.scalar_projection(V.literal([1]), V.literal([0])), V.transpose(V.literal([[1, 2], [3]]))):
            with pytest.raises(Exception):
                self.value(spark, bad)

    def test_functions(self, spark):
        assert self.value(spark, V.softmax(V.literal([2, 1, 0.1]))) == pytest.approx([0.6590, 0.2424, 0.0986], abs=1e-3)
        assert all(map(math.isfinite, self.value(spark, V.softmax(V.literal([1000, 1001, 1002])))))
        assert self.value(spark, V.sigmoid(V.literal([-2, -1, 0, 1, 2]))) == pytest.approx([0.1192, 0.2689, 0.5, 0.7311, 0.8808], abs=1e-4)
        assert self.value(spark, V.elementwise(V.literal([-2.5, 2.5, -0.4]), "round")) == [-3, 3, 0]
        log = self.value(spark, V.elementwise(V.literal([0, -1, 1]), "log"))
        assert log[0] == -math.inf and math.isnan(log[1]) and log[2] == 0
        assert self.value(spark, V.true_indices(V.compare(V.literal([1, math.nan, 3]), ">", 0.5))) == [0, 2]
        assert self.value(spark, V.scalar_divide_matrix(1, V.literal([[2, 0]]))) == [[0.5, math.inf]]

    def test_text(self, spark):
        assert self.value(spark, text.tokenize(F.lit("Hello, world! How are you?"), remove_punctuation=False)) == ["hello,", "world!", "how", "are", "you?"]
        assert self.value(spark, text.tokenize(F.lit("--flag -option don't"))) == ["flag", "option", "don't"]
        chunks = self.value(spark, text.as_chunks(text.paragraphs(F.lit("One.\n\n\n\nTwo."))))
        assert [tuple(c) for c in chunks] == [(0, "One."), (1, "Two.")]

    def test_retrieval(self, spark):
        words = [("cat", [1.0, 0, 0]), ("dog", [0.9, 0.1, 0]), ("car", [0.0, 1, 0]), ("truck", [0, 0.9, 0.1]), ("sky", [0.0, 0, 1])]
        df = spark.createDataFrame([(k, w, list(map(float, v))) for k, (w, v) in enumerate(words)], "position long, label string, vector array<double>")
        index = similarity.EmbeddingIndex(df, lambda t: F.lit(None).cast("array<double>"))
        hits = index.retrieve([1, 0, 0], 2).first()
        assert [h["label"] for h in hits["hits"]] == ["cat", "dog"] and hits["top_score"] == 1
        assert index.remove("cat").count() == 4 and index.remove_all().is_empty()

    @settings(max_examples=6, deadline=None)
    @given(st.integers(0, 1000), st.sampled_from([0.5, 0.8, 0.95, 0.99]))
    def test_duplicates_are_complete(self, spark, seed, threshold):
        random = np.random.default_rng(seed)
        x = random.standard_normal((40, 5))
        x[20:] = x[:20] + 0.2 * random.standard_normal((20, 5))
        x[7] = 0
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
        got = {(r["id1"], r["id2"]) for r in similarity.find_duplicates(df, "v", "id", threshold).collect()}
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        want = {(i, j) for i in range(40) for j in range(i + 1, 40) if 7 not in (i, j) and abs(u[i] @ u[j] - threshold) > 1e-9 and u[i] @ u[j] >= threshold}
        assert want <= got and all(u[i] @ u[j] > threshold - 1e-9 for i, j in got)

    @pytest.mark.parametrize("threshold", [0.95, 0.6])
    def test_duplicates_of_many_components(self, spark, monkeypatch, threshold):
        """Cells rule out few pairs of these vectors: they are compared in blocks, without a join of pairs."""
        monkeypatch.setattr(cells, "BLOCK", 50)
        random = np.random.default_rng(5)
        x = random.standard_normal((300, 64))
        x[150:] = x[:150] + random.uniform(0, 1, (150, 1)) * random.standard_normal((150, 64))
        x[7] = 0
        df = spark.createDataFrame([(f"v{k:03}", v.tolist()) for k, v in enumerate(x)], "id string, v array<double>")
        made = similarity.find_duplicates(df, "v", "id", threshold)
        assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        want = {(f"v{i:03}", f"v{j:03}"): u[i] @ u[j] for i in range(300) for j in range(i + 1, 300) if u[i] @ u[j] >= threshold}
        got = {(r["id1"], r["id2"]): r["similarity"] for r in made.collect()}
        assert got.keys() == want.keys() and len(got) > 30 and all(got[k] == pytest.approx(want[k]) for k in got)

    def test_cohesion(self, spark):
        x = np.random.default_rng(1).standard_normal((30, 4))
        df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        want = np.mean([(u[i] @ u[j]) for i in range(30) for j in range(i)])
        assert one(similarity.cluster_cohesion(df, "v")) == pytest.approx(want)


class TestLinalg:
    def test_solve(self):
        assert linalg.solve([[2, 1], [1, 3]], [5, 10]) == pytest.approx([1, 3])
        assert linalg.determinant([[2, 1], [1, 3]]) == 5
        assert linalg.solve([[2, 1, 1], [4, -6, 0], [-2, 7, 2]], [5, -2, 9]) == pytest.approx([1, 1, 2])
        assert linalg.solve([[1, 2], [2, 4]], [1, 2]) is None
        with pytest.raises(linalg.Singular):
            linalg.inverse([[1, 2, 3], [2, 4, 6], [1, 0, 1]])
        with pytest.raises(linalg.NotSquare):
            linalg.inverse([[1, 2, 3]])
        assert linalg.condition_number([[1, 2], [2, 4]]) == math.inf

    @settings(max_examples=30, deadline=None)
    @given(st.integers(0, 10_000), st.integers(1, 7))
    def test_lu(self, seed, n):
        a = np.random.default_rng(seed).standard_normal((n, n)) + n * np.eye(n)
        f = linalg.lu(a)
        assert np.allclose(a[f.permutation], f.lower @ f.upper)
        assert np.allclose(linalg.inverse(a), np.linalg.inv(a))
        assert linalg.log_determinant(a).value == pytest.approx(np.linalg.det(a))

    def test_fractions(self):
        assert str(Fraction.of(0.75)) == "3/4" and str(Fraction.of(-1 / 3)) == "-1/3" and str(Fraction.of(2.0)) == "2"
        assert [[str(x) for x in r] for r in as_fractions([[0.5, 0.2]])] == [["1/2", "1/5"]]

    def test_polynomials(self, spark):
        df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(range(1, 6), (6, 15, 28, 45, 66))], "x double, y double")
        p = polyfit(df, "x", "y", 2)
        assert p.coefficients == pytest.approx((1, 3, 2)) and p(6) == pytest.approx(91)
        assert polyfit(df, "x", "y", 5) is None and polyfit(df, "x", "y", -1) is None
        assert str(Polynomial([1, -3, 2])) == "2x² - 3x + 1"
        assert (Polynomial([1, 1]) * Polynomial([1, -1])).coefficients == (1, 0, -1)


class TestDistributions:
    def test_normal(self):
        for x, p in ((-2, 0.02275013194817921), (1, 0.8413447460685429), (1.96, 0.9750021048517795)):
            assert D.normal_cdf(x) == pytest.approx(p, abs=1e-15)
        assert D.normal_quantile(0.001) == pytest.approx(-3.0902323061678154, abs=5e-7)
        assert D.normal_pdf(1.96) == pytest.approx(0.05844094433345173)
        assert D.normal_cdf(0, 0, -1) is None and D.normal_quantile(0) is None

    def test_t_and_chi(self):
        for x, df, p in ((1, 1, 0.75), (2, 2, 0.9082482904638630), (2.571, 5, 0.9750126826580743), (2.228, 10, 0.9749941140914443)):
            assert D.t_cdf(x, df) == pytest.approx(p, abs=1e-13)
        for df, q in ((1, 12.706204736174694), (5, 2.5705818356363146), (30, 2.0422724563012378)):
            assert D.t_quantile(0.975, df) == pytest.approx(q, abs=1e-8)
        for x, df, p in ((3.841, 1, 0.9499863162360434), (5.991, 2, 0.9499883849734209), (11.07, 5, 0.9499903813775945)):
            assert D.chi_squared_cdf(x, df) == pytest.approx(p, abs=1e-13)

    def test_discrete(self):
        assert D.poisson_pmf(2, 3.5) == pytest.approx(0.184959, abs=1e-6) and D.poisson_cdf(5, 3.5) == pytest.approx(0.857614, abs=1e-6)
        assert D.poisson_quantile(0.95, 3.5) == 7 and D.binomial_quantile(0.95, 10, 0.4) == 7
        assert D.binomial_pmf(3, 10, 0.4) == pytest.approx(0.214991, abs=1e-6) and D.binomial_cdf(3, 10, 0.4) == pytest.approx(0.382281, abs=1e-6)
        assert D.binomial_variance(10, 0.4) == pytest.approx(2.4) and D.binomial_log_pmf(1, 3, 0.0) == -math.inf

    @settings(max_examples=40, deadline=None)
    @given(st.floats(0.001, 0.999), st.floats(1, 60))
    def test_round_trips(self, p, df):
        assert D.t_cdf(D.t_quantile(p, df), df) == pytest.approx(p, abs=1e-8)
        assert D.normal_cdf(D.normal_quantile(p)) == pytest.approx(p, abs=1e-8)

    def test_bayes(self):
        assert bayes.posterior_from_rates(0.01, 0.95, 0.02) == pytest.approx(0.3242320819112628)
        assert bayes.log_sum_exp([0, 0, 0]) == pytest.approx(math.log(3)) and bayes.log_sum_exp([1000, 1000]) == pytest.approx(1000 + math.log(2))
        found = bayes.posterior_of(bayes.prior(["a", "b"], [0.5, 0.5]), bayes.likelihood(["a", "b"], [0.2, 0.6]))
        assert found.values == pytest.approx((0.25, 0.75))
        assert bayes.prior(["a", "b"], [0.5, 0.6]) is None and bayes.posterior(0.5, 1, 0.1) is None


class TestSignal:
    def test_sine(self):
        x = np.sin(2 * np.pi * 440 * np.arange(256) / 8000)
        assert int(np.argmax(signal.magnitude_half(x))) == 14 and signal.dominant_frequency(x, 8000) == 437.5
        assert [len(signal.padded(np.ones(n))) for n in (5, 8, 9)] == [8, 8, 16]
        p = signal.power_spectral_density(np.sin(2 * np.pi * 5 * np.arange(1000) / 100), 100)
        assert len(p.frequencies) == 513 and p.frequencies[-1] == 50
        assert signal.power_spectral_density(np.ones(1), 100) is None

    def test_parseval(self):
        x = np.random.default_rng(0).standard_normal(64)
        p = signal.power_spectral_density(x, 100)
        assert p.densities.sum() * 100 / 64 == pytest.approx(np.mean(x**2))


class TestModels:
    def test_ols(self, spark):
        df = spark.createDataFrame(list(zip(map(float, range(1, 6)), (2.1, 3.9, 6.1, 8.0, 9.8))), "x double, y double")
        s = LinearRegression.summary(df, ["x"], "y")
        assert s.coefficients == pytest.approx((0.13, 1.95))
        assert s.standard_errors == pytest.approx((0.12556538801224887, 0.03785938897200176))
        assert s.p_values == pytest.approx((0.37665501431525295, 1.6117537475546229e-05))
        assert (s.r_squared, s.adjusted_r_squared, s.residual_standard_error) == pytest.approx((0.9988704423662919, 0.9984939231550558, 0.11972189997378624))
        assert s.intervals[1] == pytest.approx((1.8295145274457554, 2.070485472554247))
        assert LinearRegression.fit(df, ["x"], "y").equation() == "y = 0.13 + 1.95x₁"

    def test_descent(self, spark):
        df = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(10)], "x double, y double")
        g = GradientDescent.fit(df, ["x"], "y", 0.01, 20_000, 1e-12)
        assert g.coefficients == pytest.approx((1, 2), abs=1e-3)
        assert Ridge.fit(df, ["x"], "y", 0.0, 0.01, 100, 0.0).coefficients == GradientDescent.fit(df, ["x"], "y", 0.01, 100, 0.0).coefficients
        with pytest.raises(Diverged):
            GradientDescent.fit(df, ["x"], "y", 1.0)

    def test_logistic(self, spark):
        x = np.array([1, 2, 3, 4, 5, 6, 2.5, 4.5])
        df = spark.createDataFrame([([float(v)], y) for v, y in zip(x, (0, 0, 1, 0, 1, 1, 1, 0))], "x array<double>, y int")
        scaled = StandardScaler.fit(df, "x").transform(df, "x", "z")
        m = LogisticRegression.fit(scaled, "z", "y", 4.0, 60, 1e-10)
        assert m.coefficients == pytest.approx((0, 0.897222), abs=1e-3) and m.losses[-1] == pytest.approx(0.608465, abs=1e-5)
        with pytest.raises(ValueError):
            LogisticRegression.fit(df.withColumn("y", F.lit(2)), "x", "y")

    def test_neighbours(self, spark):
        train = spark.createDataFrame([(0, [10.0, 0.0], 0), (1, [10.0, 1.0], 0), (2, [0.1, 0.0], 1)], "id long, x array<double>, y int")
        asked = spark.createDataFrame([(9, [0.0, 0.0])], "id long, x array<double>")
        for weight, want in (("uniform", 0), ("distance", 1)):
            assert KNearestNeighbours.fit(train, "id", "x", "y", 3, weight=weight).predict(asked, "id", "x").first()["predicted"] == want
        with pytest.raises(ValueError):
            KNearestNeighbours.fit(train, "id", "x", "y", 4)

    def test_kmeans(self, spark):
        points = [(0, 0), (1, 0), (0, 1), (10, 10), (11, 10), (10, 11)]
        df = spark.createDataFrame([(k, [float(a), float(b)]) for k, (a, b) in enumerate(points)], "id long, x array<double>")
        m = KMeans.fit(df, "x", 2, "id", seed=42)
        assert sorted(c for p in m.centroids for c in p) == pytest.approx([1 / 3] * 2 + [31 / 3] * 2)
        assert sorted(initial_rows(10, 10, 3)) == list(range(10))

    def test_bayes(self, spark):
        df = spark.createDataFrame([([2.0, 4.0], 0), ([4.0, 6.0], 0), ([10.0, 20.0], 1), ([12.0, 22.0], 1)], "x array<double>, y int")
        m = GaussianNaiveBayes.fit(df, "x", "y")
        assert m.priors == (0.5, 0.5) and m.means == ((3, 5), (11, 21))
        assert [r["predicted"] for r in m.predict(df, "x").collect()] == [0, 0, 1, 1]
        assert GaussianNaiveBayes.from_json(m.to_json()).priors == m.priors

    def test_metrics(self, spark):
        df = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (0, 0), (1, 2), (2, 1)], "p int, a int")
        for r in metrics.report_averages(metrics.classification_report(df, "p", "a")).collect():
            assert r["precision"] == pytest.approx(2 / 3)
        c = metrics.confusion_matrix(spark.createDataFrame([(1, 1), (0, 0), (1, 1), (1, 0), (0, 1), (0, 0), (1, 1), (0, 0)], "p int, a int"), "p", "a").first()
        assert (c["tp"], c["fp"], c["tn"], c["fn"], c["f1"]) == (3, 1, 3, 1, 0.75)

    def test_sampling(self, spark):
        df = spark.createDataFrame([(k, int(k >= 80)) for k in range(100)], "id long, y int")
        split = sampling.stratified_split(df, "id", "y", 0.2, 1).where("is_test").groupBy("y").count().collect()
        assert {r["y"]: r["count"] for r in split} == {0: 16, 1: 4}
        sizes = sampling.k_folds(spark.range(11), "id", 3, 1).groupBy("fold").count().collect()
        assert sorted(r["count"] for r in sizes) == [3, 4, 4]
        few = spark.createDataFrame([(k, y, [float(k)]) for k, y in enumerate((0, 0, 0, 1, 1, 2))], "id long, y int, x array<double>")
        assert {r["count"] for r in sampling.oversample(few, "id", "y", "x", 1).groupBy("y").count().collect()} == {3}
        one_ = sampling.train_test_split(spark.range(50), "id", 0.3, 7).where("is_test").collect()
        assert one_ == sampling.train_test_split(spark.range(50).repartition(5), "id", 0.3, 7).where("is_test").orderBy("id").collect() or len(one_) == 15
