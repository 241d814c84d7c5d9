"""Queries of sampling, models, metrics and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.core import with_stats
from statloom.functions import bayes
from statloom.functions import distributions as D
from statloom.models.bayes import GaussianNaiveBayes, class_stats
from statloom.models.kmeans import KMeans
from statloom.models.linear import GradientDescent, LinearRegression, LogisticRegression, Moments, ResidualModel, Ridge
from statloom.models.neighbours import KNearestNeighbours
from statloom.models.pipeline import Pipeline
from statloom.models.scaling import FeatureScaler, StandardScaler
from statloom.operators import metrics, sampling
from statloom.plans.registry import query, rounded
from statloom.sources.files import table as T

SHUFFLE = "row_number() OVER (ORDER BY md5('{seed}:' || CAST({id} AS VARCHAR)), {id}) - 1"


@query(f"SELECT c_custkey, o < ceil((SELECT count(*) FROM customer) * 0.2) AS is_test FROM (SELECT c_custkey, {SHUFFLE.format(seed=42, id='c_custkey')} AS o FROM customer)")
def split_80_20(spark, d):
    return sampling.train_test_split(T(spark, d, "customer").select("c_custkey"), "c_custkey", 0.2, 42)


@query(f"""WITH s AS (SELECT c_custkey, {SHUFFLE.format(seed=7, id='c_custkey')} AS o, count(*) OVER () AS n FROM customer)
SELECT c_custkey, CAST(CASE WHEN o < (n % 7) * (n // 7 + 1) THEN o // (n // 7 + 1) ELSE n % 7 + (o - (n % 7) * (n // 7 + 1)) // (n // 7) END AS BIGINT) AS fold FROM s""")
def kfold_7(spark, d):
    return sampling.k_folds(T(spark, d, "customer").select("c_custkey"), "c_custkey", 7, 7)


@query("""WITH s AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('5:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS o, count(*) OVER (PARTITION BY quality) AS c FROM labels)
SELECT doc_id, CAST(quality AS INTEGER) AS quality, o < CASE WHEN c > 1 THEN least(greatest(1, ceil(c * 0.25)), c - 1) ELSE 0 END AS is_test FROM s""")
def stratified_split_labels(spark, d):
    return sampling.stratified_split(T(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality", 0.25, 5)


@query("SELECT o_orderkey FROM orders ORDER BY md5('3:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100")
def sample_without_replacement(spark, d):
    return sampling.sample(T(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100, 3, replace=False)


UNIT = "(CAST(('0x' || substr(md5({key}), 1, 13)) AS BIGINT) / 4503599627370496.0)"


@query(f"""WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part), d AS (SELECT draw, CAST(floor({UNIT.format(key="'9:' || draw")} * (SELECT count(*) FROM part)) AS BIGINT) AS i FROM (SELECT unnest(range(0, 250)) AS draw))
SELECT draw, p_partkey FROM d JOIN p USING (i)""")
def sample_with_replacement(spark, d):
    return sampling.sample(T(spark, d, "part").select("p_partkey"), "p_partkey", 250, 9)


@query(f"""WITH p AS (SELECT s_acctbal, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier), n AS (SELECT count(*) AS n FROM supplier),
g AS (SELECT iteration, k FROM (SELECT unnest(range(0, 50)) AS iteration), LATERAL (SELECT unnest(range(0, (SELECT n FROM n))) AS k)),
d AS (SELECT iteration, CAST(floor({UNIT.format(key="'1:' || iteration || ':' || k")} * n) AS BIGINT) AS i FROM g, n)
SELECT iteration, round(avg(s_acctbal), 4) + 0.0 AS value FROM d JOIN p USING (i) GROUP BY iteration""")
def bootstrap_mean(spark, d):
    return rounded(sampling.resampled(T(spark, d, "supplier"), "s_suppkey", "s_acctbal", F.avg, 50, 1), 4)


@query(f"""WITH p AS (SELECT c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer), n AS (SELECT count(*) AS n FROM customer),
g AS (SELECT iteration, k FROM (SELECT unnest(range(0, 40)) AS iteration), LATERAL (SELECT unnest(range(0, 30)) AS k)),
d AS (SELECT iteration, CAST(floor({UNIT.format(key="'2:' || iteration || ':' || k")} * n) AS BIGINT) AS i FROM g, n)
SELECT iteration, round(quantile_cont(c_acctbal, 0.5), 4) + 0.0 AS value FROM d JOIN p USING (i) GROUP BY iteration""")
def sampling_distribution_median(spark, d):
    return rounded(sampling.sampling_distribution_of("median", T(spark, d, "customer"), "c_custkey", "c_acctbal", 30, 40, 2), 4)


@query("SELECT CAST(quality AS INTEGER) AS quality, (SELECT max(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) AS count FROM labels GROUP BY quality")
def oversample_counts(spark, d):
    df = T(spark, d, "labels").select("doc_id", "quality", F.array(F.col("doc_id").cast("double")).alias("x"))
    return sampling.oversample(df, "doc_id", "quality", "x", 1).groupBy("quality").agg(F.count("*").alias("count"))


# Scaling


def _lineitem(spark, d):
    return T(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.array("l_quantity", "l_discount", "l_tax").alias("x"))


@query("SELECT vec_id, CAST(g.i - 1 AS INTEGER) AS position, round((e[g.i] - m) / s, 4) + 0.0 AS z FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) v, (SELECT i, avg(embedding[i]::DOUBLE) AS m, stddev_pop(embedding[i]::DOUBLE) AS s FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY i) g")
def standard_scaler(spark, d):
    df = T(spark, d, "embeddings").select("vec_id", "embedding")
    made = StandardScaler.fit(df, "embedding").transform(df, "embedding")
    return rounded(made.select("vec_id", F.posexplode("scaled").alias("position", "z")), 4)


@query("SELECT c_custkey, round((c_acctbal - a) / (b - a) * 10 - 5, 6) + 0.0 AS scaled, CAST(-5 AS DOUBLE) AS constant FROM customer, (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer)")
def minmax_scaler(spark, d):
    df = T(spark, d, "customer").select("c_custkey", F.array(F.col("c_acctbal"), F.lit(3.0)).alias("x"))
    made = FeatureScaler.fit(df, "x", -5, 5).transform(df, "x", "s")
    return rounded(made.select("c_custkey", F.get("s", F.lit(0)).alias("scaled"), F.get("s", F.lit(1)).alias("constant")))


# Linear models


@query("SELECT round(regr_intercept(p_retailprice, p_size), 4) + 0.0 AS intercept, round(regr_slope(p_retailprice, p_size), 6) + 0.0 AS slope, round(regr_r2(p_retailprice, p_size), 6) + 0.0 AS r2 FROM part")
def ols_simple(spark, d):
    s = LinearRegression.summary(T(spark, d, "part"), ["p_size"], "p_retailprice")
    return rounded(spark.range(1).select(F.lit(s.coefficients[0]).alias("intercept"), F.lit(s.coefficients[1]).alias("slope"), F.lit(s.r_squared).alias("r2")), 6, intercept=4)


TWO = """WITH m AS (SELECT avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_extendedprice) AS y FROM lineitem),
s AS (SELECT sum((l_quantity - a) ** 2) AS aa, sum((l_discount - b) ** 2) AS bb, sum((l_quantity - a) * (l_discount - b)) AS ab, sum((l_quantity - a) * (l_extendedprice - y)) AS ay, sum((l_discount - b) * (l_extendedprice - y)) AS bys FROM lineitem, m),
w AS (SELECT (ay * bb - bys * ab) / (aa * bb - ab * ab) AS w1, (bys * aa - ay * ab) / (aa * bb - ab * ab) AS w2 FROM s), c AS (SELECT y - w1 * a - w2 * b AS w0, w1, w2 FROM w, m)
"""


@query(TWO + "SELECT round(w0, 2) + 0.0 AS w0, round(w1, 3) + 0.0 AS w1, round(w2, 2) + 0.0 AS w2 FROM c")
def ols_two_feature(spark, d):
    w = LinearRegression.fit(_lineitem(spark, d), ["l_quantity", "l_discount"], "l_extendedprice").coefficients
    return rounded(spark.range(1).select(*(F.lit(v).alias(f"w{k}") for k, v in enumerate(w))), 2, w1=3)


@query(TWO + ", p AS (SELECT l_extendedprice AS y, w0 + w1 * l_quantity + w2 * l_discount AS p FROM lineitem, c) SELECT round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 5) + 0.0 AS r2, round(avg((y - p) ** 2), 0) + 0.0 AS mse, round(sqrt(avg((y - p) ** 2)), 2) + 0.0 AS rmse FROM p")
def ols_predict_r2_mse(spark, d):
    df = _lineitem(spark, d)
    model = LinearRegression.fit(df, ["l_quantity", "l_discount"], "l_extendedprice")
    made = metrics.regression_metrics(model.predict(df, ["l_quantity", "l_discount"]), "predicted", "l_extendedprice")
    return rounded(made, 5, mse=0, rmse=2)


@query("""WITH m AS (SELECT count(*) AS n, avg(p_size) AS x, avg(p_retailprice) AS y FROM part), s AS (SELECT sum((p_size - x) ** 2) AS xx, regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a FROM part, m),
e AS (SELECT sqrt(sum((p_retailprice - a - b * p_size) ** 2) / (count(*) - 2)) AS se FROM part, s)
SELECT t.term, round(CASE t.term WHEN 'intercept' THEN a ELSE b END, 4) + 0.0 AS coefficient, round(CASE t.term WHEN 'intercept' THEN se * sqrt(1.0 / n + x * x / xx) ELSE se / sqrt(xx) END, 4) + 0.0 AS standard_error FROM m, s, e, (VALUES ('intercept'), ('x1')) AS t(term)""")
def ols_summary(spark, d):
    s = LinearRegression.summary(T(spark, d, "part"), ["p_size"], "p_retailprice")
    return rounded(s.to_frame(spark).select("term", "coefficient", "standard_error"), 4)


@query("""WITH m AS (SELECT avg(l_discount) AS x, avg(l_tax) AS y, var_pop(l_discount) AS xx, covar_pop(l_discount, l_tax) AS xy FROM lineitem)
SELECT round(y - xy / (xx + 0.01) * x, 6) + 0.0 AS w0, round(xy / (xx + 0.01), 6) + 0.0 AS w1 FROM m""")
def ridge_closed_limit(spark, d):
    w = Ridge.limit(Moments.of(_lineitem(spark, d), ["l_discount"], "l_tax"), 0.01)
    return rounded(spark.range(1).select(F.lit(float(w[0])).alias("w0"), F.lit(float(w[1])).alias("w1")))


STEPS = """WITH RECURSIVE m AS (SELECT avg(l_discount) AS x, avg(l_tax) AS y, avg(l_discount ** 2) AS xx, avg(l_discount * l_tax) AS xy FROM lineitem),
g(i, w0, w1) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) UNION ALL SELECT i + 1, w0 - 0.5 * 2 * (w0 + w1 * x - y), w1 - 0.5 * (2 * (w0 * x + w1 * xx - xy) + 2 * {s} * w1) FROM g, m WHERE i < 50)
SELECT round(w0, 6) + 0.0 AS w0, round(w1, 6) + 0.0 AS w1 FROM g WHERE i = 50"""


@query(STEPS.format(s=0))
def gd_fixed_iterations(spark, d):
    w = GradientDescent.fit(_lineitem(spark, d), ["l_discount"], "l_tax", 0.5, 50, 0.0).coefficients
    return rounded(spark.range(1).select(F.lit(w[0]).alias("w0"), F.lit(w[1]).alias("w1")))


@query(STEPS.format(s=0.05))
def ridge_fixed_iterations(spark, d):
    w = Ridge.fit(_lineitem(spark, d), ["l_discount"], "l_tax", 0.05, 0.5, 50, 0.0).coefficients
    return rounded(spark.range(1).select(F.lit(w[0]).alias("w0"), F.lit(w[1]).alias("w1")))


@query("SELECT p_partkey, round(p_retailprice - (SELECT regr_intercept(p_retailprice, p_size) FROM part) - (SELECT regr_slope(p_retailprice, p_size) FROM part) * p_size, 4) + 0.0 AS residual FROM part")
def residuals(spark, d):
    df = T(spark, d, "part")
    model = ResidualModel(LinearRegression.fit(df, ["p_size"], "p_retailprice"))
    return rounded(model.residuals(df, ["p_size"], "p_retailprice").select("p_partkey", "residual"), 4)


@query("""WITH a AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END AS y, l_discount AS x FROM lineitem), s AS (SELECT -0.5 * avg(0.5 - y) AS w0, -0.5 * avg((0.5 - y) * x) AS w1 FROM a)
SELECT round(w0, 8) + 0.0 AS w0, round(w1, 8) + 0.0 AS w1, round((SELECT avg(-(y * ln(1 / (1 + exp(-w0 - w1 * x))) + (1 - y) * ln(1 - 1 / (1 + exp(-w0 - w1 * x))))) FROM a), 6) + 0.0 AS loss FROM s""")
def logistic_one_step(spark, d):
    df = T(spark, d, "lineitem").select(F.array("l_discount").alias("x"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))
    m = LogisticRegression.fit(df, "x", "y", 0.5, 1, 0.0)
    return rounded(spark.range(1).select(F.lit(m.coefficients[0]).alias("w0"), F.lit(m.coefficients[1]).alias("w1"), F.lit(m.losses[1]).alias("loss")), 8, loss=6)


# Classifiers


def _embeddings(spark, d):
    return T(spark, d, "embeddings").select("vec_id", "embedding", "label")


NB = """WITH x AS (SELECT vec_id, label, g.i AS i, CAST(embedding[g.i] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) g),
c AS (SELECT label, i, count(*) AS n, avg(x) AS m, greatest(var_pop(x), 1e-9) AS v FROM x GROUP BY label, i),
j AS (SELECT x.vec_id, x.label AS actual, c.label, ln(any_value(c.n) / (SELECT count(*) FROM embeddings)) + sum(-0.5 * (ln(2 * pi() * c.v) + (x.x - c.m) ** 2 / c.v)) AS lj FROM x JOIN c USING (i) GROUP BY x.vec_id, x.label, c.label)
"""


@query(NB + "SELECT CAST(label AS INTEGER) AS label, CAST(i - 1 AS INTEGER) AS position, n, round(m, 6) + 0.0 AS mean, round(v, 6) + 0.0 AS variance FROM c")
def nb_class_stats(spark, d):
    return rounded(class_stats(_embeddings(spark, d), "embedding", "label"))


@query(NB + "SELECT vec_id, CAST(arg_max(label, lj) AS INTEGER) AS predicted FROM j GROUP BY vec_id")
def nb_predict(spark, d):
    df = _embeddings(spark, d)
    return GaussianNaiveBayes.fit(df, "embedding", "label").predict(df, "embedding").select("vec_id", "predicted")


@query(NB + ", t AS (SELECT *, max(lj) OVER (PARTITION BY vec_id) AS top FROM j) SELECT vec_id, CAST(label AS INTEGER) AS label, round(exp(lj - top) / sum(exp(lj - top)) OVER (PARTITION BY vec_id), 5) + 0.0 AS probability FROM t")
def nb_posteriors(spark, d):
    df = _embeddings(spark, d)
    m = GaussianNaiveBayes.fit(df, "embedding", "label")
    made = df.select("vec_id", F.posexplode(m.probabilities("embedding")).alias("k", "probability"))
    return rounded(made.select("vec_id", F.get(F.array(*map(F.lit, m.labels)), "k").alias("label"), "probability"), 5)


NEAR = """WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0), t AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT q.vec_id AS query, t.vec_id AS neighbour, t.label, {dist} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {dist}, t.vec_id) AS rank FROM q CROSS JOIN t QUALIFY rank <= {k})
"""
EUCLID = "sqrt(list_sum([(z[1] - z[2]) ** 2 for z in list_zip(q.e, t.e)]))"
COS = "greatest(round(1 - list_inner_product(q.e, t.e) / sqrt(list_inner_product(q.e, q.e) * list_inner_product(t.e, t.e)), 12), 0)"


def _knn(spark, d, **options):
    """A model of all rows, and the queries: every row whose id is divisible by 20."""
    df = _embeddings(spark, d)
    return KNearestNeighbours.fit(df, "vec_id", "embedding", "label", **options), df.where("vec_id % 20 = 0")


@query(NEAR.format(dist=EUCLID, k=5) + ", v AS (SELECT query, label, count(*) AS n FROM n GROUP BY 1, 2) SELECT query, CAST(label AS INTEGER) AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, label) AS place FROM v) WHERE place = 1")
def knn_predict(spark, d):
    model, queries = _knn(spark, d, k=5)
    return model.predict(queries, "vec_id", "embedding")


@query(NEAR.format(dist=COS, k=7) + ", z AS (SELECT query, max(CASE WHEN distance < 1e-12 THEN 1 ELSE 0 END) AS exact FROM n GROUP BY 1), v AS (SELECT query, label, sum(CASE WHEN exact = 1 THEN CASE WHEN distance < 1e-12 THEN 1.0 ELSE 0 END ELSE 1 / distance END) AS n FROM n JOIN z USING (query) GROUP BY 1, 2) SELECT query, CAST(label AS INTEGER) AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, label) AS place FROM v) WHERE place = 1")
def knn_weighted_cosine(spark, d):
    model, queries = _knn(spark, d, k=7, metric="cosine", weight="distance")
    return model.predict(queries, "vec_id", "embedding")


@query(NEAR.format(dist=EUCLID, k=3) + "SELECT query, neighbour, round(distance, 5) + 0.0 AS distance FROM n")
def knn_neighbours(spark, d):
    model, queries = _knn(spark, d, k=3)
    return rounded(model.neighbours(queries, "vec_id", "embedding").select("query", "neighbour", "distance"), 5)


KM = "SELECT p.id, c.k, row_number() OVER (PARTITION BY p.id ORDER BY (p.x - c.x) ** 2 + (p.y - c.y) ** 2, c.k) AS place, (p.x - c.x) ** 2 + (p.y - c.y) ** 2 AS dist, p.x, p.y FROM p CROSS JOIN {c} c QUALIFY place = 1"


@query(f"""WITH p AS (SELECT l_linenumber * 1000000 + row_number() OVER (ORDER BY l_extendedprice, l_quantity, l_orderkey, l_linenumber) AS id, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem),
c0 AS (SELECT * FROM (VALUES (0, 10.0, 20.0), (1, 25.0, 50.0), (2, 40.0, 80.0)) AS v(k, x, y)), a1 AS ({KM.format(c='c0')}), c1 AS (SELECT k, avg(x) AS x, avg(y) AS y FROM a1 GROUP BY k), a2 AS ({KM.format(c='c1')}), c2 AS (SELECT k, avg(x) AS x, avg(y) AS y FROM a2 GROUP BY k), a3 AS ({KM.format(c='c2')})
SELECT CAST(c2.k AS INTEGER) AS cluster, round(c2.x, 4) + 0.0 AS x, round(c2.y, 4) + 0.0 AS y, (SELECT round(sum(dist), 1) + 0.0 FROM a3) AS inertia FROM c2""")
def kmeans_two_steps(spark, d):
    df = T(spark, d, "lineitem").select(F.array(F.col("l_quantity"), F.col("l_extendedprice") / 1000).alias("x"))
    m = KMeans.fit(df, "x", 3, iterations=2, start=[[10, 20], [25, 50], [40, 80]])
    rows = [(k, *c, m.inertia) for k, c in enumerate(m.centroids)]
    return rounded(spark.createDataFrame(rows, "cluster int, x double, y double, inertia double"), 4, inertia=1)


def _lloyd(steps):
    """So many steps of Lloyd's iterations of c0 (k, c, m) over v (p, e), for all k at once."""
    out = []
    for t in range(steps + 1):
        out.append(f"a{t} AS (SELECT k, p, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT k, p, c, list_sum([(x[1] - x[2]) ** 2 for x in list_zip(e, m)]) AS d FROM v, c{t}) GROUP BY k, p)")
        if t < steps:
            out.append(f"c{t + 1} AS (SELECT k, c, list(x ORDER BY i) AS m FROM (SELECT k, c, i, avg(e[i]) AS x FROM a{t} JOIN v USING (p), (SELECT unnest(range(1, 65)) AS i) GROUP BY k, c, i) GROUP BY k, c)")
    return ", ".join(out)


#: The first centroids are the first rows of a shuffle that swaps each place, from the last on, with one drawn by a congruential generator.
SHUFFLE = """v AS (SELECT embedding::DOUBLE[] AS e, row_number() OVER (ORDER BY vec_id) - 1 AS p FROM embeddings),
s(i, state, l) AS (SELECT count(*) - 1, CAST(42 AS UHUGEINT), range(0, count(*)) FROM v
UNION ALL SELECT i - 1, state, [CASE WHEN x = i THEN l[j + 1] WHEN x = j THEN l[i + 1] ELSE l[x + 1] END for x in range(0, len(l))]
FROM (SELECT i, l, state, CAST(state % CAST(i + 1 AS UHUGEINT) AS BIGINT) AS j FROM (SELECT i, l, (state * CAST(6364136223846793005 AS UHUGEINT) + CAST(1442695040888963407 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS state FROM s WHERE i >= 1))),
c0 AS (SELECT k, c, e AS m FROM (SELECT k, l, unnest(range(0, k)) AS c FROM s, (SELECT unnest([2, 3, 4]) AS k) WHERE i = 0) JOIN v ON p = l[c + 1])"""


@query(f"WITH RECURSIVE {SHUFFLE}, {_lloyd(5)} SELECT CAST(k AS INTEGER) AS k, round(sum(d), 4) + 0.0 AS inertia FROM a5 GROUP BY k")
def kmeans_elbow(spark, d):
    df = _embeddings(spark, d)
    rows = KMeans.elbow(df, "embedding", range(2, 5), "vec_id", iterations=5, seed=42)
    return rounded(spark.createDataFrame(rows, "k int, inertia double"), 4)


@query("""WITH s AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) - 1 < ceil((SELECT count(*) FROM embeddings) * 0.25) AS is_test FROM embeddings),
r AS (SELECT vec_id, label, is_test, g.i AS i, CAST(embedding[g.i] AS DOUBLE) AS x FROM s, (SELECT unnest(range(1, 65)) AS i) g), z AS (SELECT i, avg(x) AS m, stddev_pop(x) AS d FROM r WHERE NOT is_test GROUP BY i),
x AS (SELECT vec_id, label, is_test, i, (x - m) / d AS x FROM r JOIN z USING (i)), c AS (SELECT label, i, count(*) AS n, avg(x) AS m, greatest(var_pop(x), 1e-9) AS v FROM x WHERE NOT is_test GROUP BY label, i),
j AS (SELECT x.vec_id, x.label AS actual, c.label, ln(any_value(c.n) / (SELECT count(*) FROM s WHERE NOT is_test)) + sum(-0.5 * (ln(2 * pi() * c.v) + (x.x - c.m) ** 2 / c.v)) AS lj FROM x JOIN c USING (i) WHERE x.is_test GROUP BY x.vec_id, x.label, c.label),
p AS (SELECT actual AS a, arg_max(label, lj) AS p FROM j GROUP BY vec_id, actual), l AS (SELECT DISTINCT a AS label FROM p UNION SELECT DISTINCT p FROM p),
n AS (SELECT label, count(*) FILTER (p = label AND a = label) AS tp, count(*) FILTER (p = label) AS np, count(*) FILTER (a = label) AS support FROM p, l GROUP BY label), m AS (SELECT label, tp / nullif(np, 0) AS precision, tp / nullif(support, 0) AS recall, support FROM n)
SELECT CAST(label AS INTEGER) AS label, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall, round(2 * precision * recall / nullif(precision + recall, 0), 6) + 0.0 AS f1, support FROM m""")
def pipeline_report(spark, d):
    """Split, scale, fit naive Bayes, predict the rest, and report by class."""
    df = sampling.train_test_split(_embeddings(spark, d), "vec_id", 0.25, 42)
    model = Pipeline.naive_bayes(df.where("not is_test"), "embedding", "label")
    made = model.predict(df.where("is_test"), "embedding")
    return rounded(metrics.classification_report(made, "predicted", "label"))


# Metrics

PREDICTED = "CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END"


def _predictions(spark, d):
    return T(spark, d, "labels").select("doc_id", "quality", F.expr(PREDICTED).cast("int").alias("predicted"))


@query(f"""WITH p AS (SELECT quality AS a, {PREDICTED} AS p FROM labels), c AS (SELECT count(*) FILTER (p = 1 AND a = 1) AS tp, count(*) FILTER (p = 1 AND a <> 1) AS fp, count(*) FILTER (p <> 1 AND a <> 1) AS tn, count(*) FILTER (p <> 1 AND a = 1) AS fn FROM p)
SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) + 0.0 AS accuracy, round(tp / (tp + fp), 6) + 0.0 AS precision, round(tp / (tp + fn), 6) + 0.0 AS recall, round(2 * tp / (2 * tp + fp + fn), 6) + 0.0 AS f1 FROM c""")
def confusion_matrix(spark, d):
    return rounded(metrics.confusion_matrix(_predictions(spark, d), "predicted", "quality"))


REPORT = f"""WITH p AS (SELECT quality AS a, {PREDICTED} AS p FROM labels), l AS (SELECT DISTINCT a AS label FROM p UNION SELECT DISTINCT p FROM p),
c AS (SELECT label, count(*) FILTER (p = label AND a = label) AS tp, count(*) FILTER (p = label) AS np, count(*) FILTER (a = label) AS support FROM p, l GROUP BY label),
m AS (SELECT label, tp / np AS precision, tp / support AS recall, 2 * tp / (np + support) AS f1, support FROM c)
"""


@query(REPORT + "SELECT CAST(label AS INTEGER) AS label, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall, round(f1, 6) + 0.0 AS f1, support FROM m")
def classification_report(spark, d):
    return rounded(metrics.classification_report(_predictions(spark, d), "predicted", "quality"))


@query(REPORT + """SELECT 'macro' AS average, round(avg(precision), 6) + 0.0 AS precision, round(avg(recall), 6) + 0.0 AS recall, round(avg(f1), 6) + 0.0 AS f1, round(sum(recall * support) / sum(support), 6) + 0.0 AS accuracy, CAST(sum(support) AS BIGINT) AS support FROM m
UNION ALL SELECT 'weighted', round(sum(precision * support) / sum(support), 6) + 0.0, round(sum(recall * support) / sum(support), 6) + 0.0, round(sum(f1 * support) / sum(support), 6) + 0.0, round(sum(recall * support) / sum(support), 6) + 0.0, CAST(sum(support) AS BIGINT) FROM m""")
def classification_averages(spark, d):
    return rounded(metrics.report_averages(metrics.classification_report(_predictions(spark, d), "predicted", "quality")))


# Distributions and Bayes


@query("""WITH s AS (SELECT avg(c_acctbal / 1000) AS m, stddev_samp(c_acctbal / 1000) AS d FROM customer), z AS (SELECT c_custkey, d, (c_acctbal / 1000 - m) / d AS z FROM customer, s)
SELECT c_custkey, round(exp(-0.5 * z * z) / (d * sqrt(2 * pi())), 8) + 0.0 AS pdf, round(-0.5 * z * z - ln(d) - 0.5 * ln(2 * pi()), 6) + 0.0 AS log_pdf FROM z""")
def normal_pdf_logpdf(spark, d):
    """Densities of the balances under a normal distribution that is fitted to them."""
    x = F.col("c_acctbal") / 1000
    customers = T(spark, d, "customer").select("c_custkey", "c_acctbal")
    m, sd = customers.agg(F.avg(x), F.stddev_samp(x)).first()
    return rounded(customers.select("c_custkey", D.normal_pdf_column(x, m, sd).alias("pdf"), D.normal_log_pdf_column(x, m, sd).alias("log_pdf")), 8, log_pdf=6)


def _horner(c, x):
    out = repr(c[0])
    for v in c[1:]:
        out = f"({out}) * {x} + {v!r}"
    return f"({out})"


#: Each part's share in the order of keys, as a probability that is neither 0 nor 1.
SHARE = "p AS (SELECT p_partkey AS k, CAST(p_partkey + 1 AS DOUBLE) / (max(p_partkey) OVER () + 2) AS p FROM part)"


def _shares(spark, d):
    parts = with_stats(T(spark, d, "part").select("p_partkey"), _most=F.max("p_partkey"))
    return parts.select("p_partkey", ((F.col("p_partkey") + 1).cast("double") / (F.col("_most") + 2)).alias("p"))


@query(f"""WITH {SHARE}, q AS (SELECT k, p, p - 0.5 AS c, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM p)
SELECT k AS p_partkey, round(CASE WHEN p < {D.TAIL} THEN {_horner(D.QUANTILE_C, 't')} / {_horner((*D.QUANTILE_D, 1.0), 't')} WHEN p > 1 - {D.TAIL} THEN -{_horner(D.QUANTILE_C, 't')} / {_horner((*D.QUANTILE_D, 1.0), 't')} ELSE c * {_horner(D.QUANTILE_A, '(c * c)')} / {_horner((*D.QUANTILE_B, 1.0), '(c * c)')} END, 7) + 0.0 AS z FROM q""")
def normal_quantile(spark, d):
    return rounded(_shares(spark, d).select("p_partkey", D.normal_quantile_column(F.col("p")).alias("z")), 7)


ORDERS = "n AS (SELECT c_custkey, c_nationkey, count(o_orderkey) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2), r AS (SELECT c_nationkey, avg(k) AS rate, count(*) AS n, avg(CASE WHEN k > 8 THEN 1.0 ELSE 0.0 END) AS p FROM n GROUP BY 1)"


def _orders_by_customer(spark, d):
    """(c_custkey, c_nationkey, k), k being the customer's number of orders; and by nation their mean, number, and the share of those with more than 8."""
    orders = T(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    n = T(spark, d, "customer").select("c_custkey", "c_nationkey").join(orders, "c_custkey", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return n, n.groupBy("c_nationkey").agg(F.avg("k").alias("rate"), F.count("*").alias("n"), F.avg(F.when(F.col("k") > 8, 1.0).otherwise(0.0)).alias("p"))


@query(f"""WITH {ORDERS} SELECT c_custkey, round(exp(k * ln(rate) - rate - lgamma(k + 1)), 8) + 0.0 AS pmf,
round(list_sum([exp(j * ln(rate) - rate - lgamma(j + 1)) for j in range(0, k + 1)]), 8) + 0.0 AS cdf FROM n JOIN r USING (c_nationkey)""")
def poisson_pmf_cdf(spark, d):
    """How likely each customer's number of orders is, if orders come at its nation's rate."""
    n, rates = _orders_by_customer(spark, d)
    made = n.join(rates, "c_nationkey")
    return rounded(made.select("c_custkey", D.column(D.poisson_pmf)("k", "rate").alias("pmf"), D.column(D.poisson_cdf)("k", "rate").alias("cdf")), 8)


LINES = "l AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS k FROM lineitem GROUP BY 1), s AS (SELECT sum(k) / sum(n) AS p FROM l)"


@query(f"""WITH {LINES} SELECT l_orderkey, round(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p)), 8) + 0.0 AS pmf,
round(list_sum([exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p)) for j in range(0, k + 1)]), 8) + 0.0 AS cdf FROM l, s""")
def binomial_pmf_cdf(spark, d):
    """How likely an order's number of much discounted lines is, of its number of lines and at the share of all lines."""
    lines = T(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("k"))
    made = with_stats(lines, p=F.sum("k") / F.sum("n"))
    return rounded(made.select("l_orderkey", D.column(D.binomial_pmf)("k", "n", "p").alias("pmf"), D.column(D.binomial_cdf)("k", "n", "p").alias("cdf")), 8)


@query("SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN 1 - exp(-c_acctbal / 2000) ELSE 0 END, 8) + 0.0 AS chi2_df2, round(0.5 + atan(c_acctbal / 1000) / pi(), 8) + 0.0 AS t_df1 FROM customer")
def chi2_t_closed_forms(spark, d):
    """Distribution functions of the balances, in thousands, with degrees of freedom that have a closed form."""
    x = F.col("c_acctbal").cast("double") / 1000
    return rounded(T(spark, d, "customer").select("c_custkey", D.column(D.chi_squared_cdf, 2)(x).alias("chi2_df2"), D.column(D.t_cdf, 1)(x).alias("t_df1")), 8)


#: The distribution function of the normal distribution less a half: a series of positive terms.
ERROR = "sign(x) * exp(-x * x / 2) / sqrt(2 * pi()) * list_sum([exp((2 * n + 1) * ln(greatest(abs(x), 1e-300)) - (n + 1) * ln(2) - lgamma(n + 1.5) + 0.5 * ln(pi())) for n in range(0, 150)])"


@query(f"""WITH {SHARE}, x AS (SELECT k, p, 8 * p - 4 AS x FROM p), j AS (SELECT unnest(range(0, 60)) AS j), a AS (SELECT j, sum(exp(j * ln(3.5) - 3.5 - lgamma(j + 1))) OVER (ORDER BY j) AS c FROM j),
b AS (SELECT j, sum(exp(lgamma(11) - lgamma(j + 1) - lgamma(11 - j) + j * ln(0.4) + (10 - j) * ln(0.6))) OVER (ORDER BY j) AS c FROM j WHERE j <= 10)
SELECT k AS p_partkey, round(0.5 + {ERROR}, 6) + 0.0 AS normal_cdf, round((2 * p - 1) / sqrt(2 * p * (1 - p)), 6) + 0.0 AS t_quantile,
CAST((SELECT count(*) FROM a WHERE c < p) AS DOUBLE) AS poisson, CAST((SELECT count(*) FROM b WHERE c < p) AS DOUBLE) AS binomial FROM x""")
def distribution_quantiles(spark, d):
    p = F.col("p")
    return rounded(_shares(spark, d).select("p_partkey", D.column(D.normal_cdf)(8 * p - 4).alias("normal_cdf"), D.column(D.t_quantile, 2)(p).alias("t_quantile"), D.column(D.poisson_quantile, 3.5)(p).alias("poisson"), D.column(D.binomial_quantile, 10, 0.4)(p).alias("binomial")))


@query(f"WITH {ORDERS} SELECT c_nationkey, round(rate, 6) + 0.0 AS poisson_mean, round(rate, 6) + 0.0 AS poisson_variance, round(n * p, 6) + 0.0 AS binomial_mean, round(n * p * (1 - p), 6) + 0.0 AS binomial_variance FROM r")
def distribution_moments(spark, d):
    """Of each nation's number of orders a customer, and of its customers with more than 8."""
    _, rates = _orders_by_customer(spark, d)
    one = {"poisson_mean": D.poisson_mean, "poisson_variance": D.poisson_variance}
    two = {"binomial_mean": D.binomial_mean, "binomial_variance": D.binomial_variance}
    return rounded(rates.select("c_nationkey", *(D.column(f)("rate").alias(n) for n, f in one.items()), *(D.column(f)("n", "p").alias(n) for n, f in two.items())))


@query("""WITH c AS (SELECT o_orderpriority AS priority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1)
SELECT priority, round(f / sum(f) OVER (), 8) + 0.0 AS posterior, round(f / sum(f) OVER (), 8) + 0.0 AS from_rates FROM c""")
def bayes_posterior(spark, d):
    """Of a finished order, the probability of each priority: by the evidence, and by rates among the priority and all others."""
    c = T(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    c = with_stats(c, _n=F.sum("n"), _f=F.sum("f"))
    prior, true, false, evidence = F.col("n") / F.col("_n"), F.col("f") / F.col("n"), (F.col("_f") - F.col("f")) / (F.col("_n") - F.col("n")), F.col("_f") / F.col("_n")
    return rounded(c.select("priority", bayes.posterior_column(prior, true, evidence).alias("posterior"), bayes.posterior_column(prior, true, prior * true + (1 - prior) * false).alias("from_rates")), 8)


@query("WITH c AS (SELECT l_returnflag AS flag, count(*) / (SELECT count(*) FROM lineitem) AS prior, avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0 END) AS likelihood FROM lineitem GROUP BY 1) SELECT flag, round(prior * likelihood / sum(prior * likelihood) OVER (), 6) + 0.0 AS posterior FROM c")
def bayes_multi(spark, d):
    li = T(spark, d, "lineitem")
    n = li.count()
    c = li.groupBy(F.col("l_returnflag").alias("flag")).agg((F.count("*") / F.lit(n)).alias("prior"), F.avg(F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0)).alias("likelihood"))
    return rounded(bayes.posteriors(c, "prior", "likelihood").select("flag", "posterior"))


