"""Queries of matrices, constructors, clusters' members, text retrieval and transforms of short series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from statloom.functions import linalg
from statloom.functions import vectors as V
from statloom.models.kmeans import KMeans
from statloom.operators import frame, sampling, signal, similarity
from statloom.plans.modelling import UNIT
from statloom.plans.registry import query, r, rounded
from statloom.sources.files import table as T


def _square(n):
    """The first n x n components of each embedding as a matrix with 2 added to its diagonal."""
    row = lambda i: F.array(*(F.get("embedding", F.lit(i * n + j)).cast("double") + F.lit(2.0 if i == j else 0.0) for j in range(n)))
    return F.array(*map(row, range(n)))


E3 = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), m AS (SELECT vec_id, e[1] + 2 AS a, e[2] AS b, e[3] AS c, e[4] AS d, e[5] + 2 AS e, e[6] AS f, e[7] AS g, e[8] AS h, e[9] + 2 AS i FROM e), d AS (SELECT *, a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g) AS det FROM m)"


@query(E3 + " SELECT vec_id, round(det, 5) + 0.0 AS determinant, round(ln(abs(det)), 5) + 0.0 AS log_abs, round((e * i - f * h) / det, 5) + 0.0 AS inverse_11, round((b * f - c * e) / det, 5) + 0.0 AS inverse_13 FROM d")
def matrix_inverses(spark, d):
    m = T(spark, d, "embeddings").select("vec_id", _square(3).alias("m"))
    inverse = m.withColumn("inverse", linalg.column(linalg.inverse, "array<array<double>>")("m"))
    at = lambda i, j: F.get(F.get("inverse", F.lit(i)), F.lit(j))
    return rounded(inverse.select("vec_id", linalg.column(linalg.determinant)("m").alias("determinant"), linalg.column(lambda a: linalg.log_determinant(a).log_abs)("m").alias("log_abs"), at(0, 0).alias("inverse_11"), at(0, 2).alias("inverse_13")), 5)


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), m AS (SELECT vec_id, e[1] + 2 AS a, e[2] AS b, e[3] AS c, e[4] + 2 AS d FROM e), n AS (SELECT *, a * d - b * c AS det FROM m)
SELECT vec_id, round(greatest(abs(a) + abs(c), abs(b) + abs(d)) * greatest(abs(d) + abs(c), abs(b) + abs(a)) / abs(det), 5) + 0.0 AS condition, round((d - 2 * b) / det, 5) + 0.0 AS x1, round((2 * a - c) / det, 5) + 0.0 AS x2 FROM n""")
def matrix_condition_and_solution(spark, d):
    m = T(spark, d, "embeddings").select("vec_id", _square(2).alias("m"), F.array(F.lit(1.0), F.lit(2.0)).alias("b"))
    m = m.withColumn("x", linalg.column(linalg.solve, "array<double>")("m", "b"))
    return rounded(m.select("vec_id", linalg.column(linalg.condition_number)("m").alias("condition"), F.get("x", F.lit(0)).alias("x1"), F.get("x", F.lit(1)).alias("x2")), 5)


@query("SELECT label, CAST(i - 1 AS INTEGER) AS position, round(avg(embedding[i]::DOUBLE), 5) + 0.0 AS mean FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i")
def averaged_by_label(spark, d):
    means = similarity.averaged(T(spark, d, "embeddings"), "embedding", ("label",))
    return rounded(means.select("label", F.posexplode("mean").alias("position", "mean")), 5)


@query("""SELECT 'panel' AS kind, vec_id AS key, CAST(i - 1 AS BIGINT) AS position, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)
UNION ALL SELECT 'reshaped', vec_id, CAST(i - 1 AS BIGINT), CAST(embedding[24 + i] AS DOUBLE) FROM embeddings, (SELECT unnest(range(1, 9)) AS i)
UNION ALL SELECT 'columns', n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1, CAST(n_regionkey AS DOUBLE) FROM nation
UNION ALL SELECT 'matrix', r_regionkey, row_number() OVER (ORDER BY r_regionkey) - 1, CAST(length(r_name) AS DOUBLE) FROM region
UNION ALL SELECT 'identity', n_nationkey, CAST(i AS BIGINT), CASE WHEN i = n_regionkey * 6 THEN 1.0 ELSE 0.0 END FROM nation, (SELECT unnest(range(0, 25)) AS i) WHERE i // 5 = n_regionkey
UNION ALL SELECT 'ones', c_custkey, 0, CAST(c_acctbal + 1 AS DOUBLE) FROM customer
UNION ALL SELECT 'zeros', c_custkey, 0, CAST(c_acctbal AS DOUBLE) FROM customer""")
def constructed_frames(spark, d):
    """Tables from vectors, columns and matrices, and generated vectors and matrices met with those of tables."""
    kind = lambda df, name: df.select(F.lit(name).alias("kind"), F.col("key").cast("long"), F.col("position").cast("long"), F.col("x").cast("double"))
    vectors = T(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"))
    panel = vectors.select("key", F.posexplode(V.as_doubles("v")).alias("position", "x"))
    reshaped = vectors.select("key", F.posexplode(F.get(V.reshaped(V.as_doubles("v"), 8, 8), F.lit(3))).alias("position", "x"))
    nations = sorted(T(spark, d, "nation").select("n_nationkey", "n_regionkey").collect())  # 25 rows at every size
    columns = frame.from_columns(spark, {"key": [r[0] for r in nations], "x": [r[1] for r in nations]})
    regions = sorted(T(spark, d, "region").select("r_regionkey", F.length("r_name")).collect())
    matrix = frame.from_matrix(spark, [[float(k), float(n)] for k, n in regions], ["key", "x"])
    units = T(spark, d, "nation").select(F.col("n_nationkey").alias("key"), "n_regionkey", F.posexplode(V.flattened(V.identity(5))).alias("position", "x")).where("position div 5 = n_regionkey")
    balance = T(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.array(F.col("c_acctbal").cast("double")).alias("v"))
    shifted = lambda w: balance.select("key", F.posexplode(V.add("v", w)).alias("position", "x"))
    out = kind(panel, "panel")
    for df, name in ((reshaped, "reshaped"), (columns, "columns"), (matrix, "matrix"), (units, "identity"), (shifted(V.ones(1)), "ones"), (shifted(V.zeros(1)), "zeros")):
        out = out.unionByName(kind(df, name))
    return out


@query(f"""WITH p AS (SELECT c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer), n AS (SELECT count(*) AS n FROM customer),
g AS (SELECT iteration, k FROM (SELECT unnest(range(0, 60)) AS iteration), LATERAL (SELECT unnest(range(0, 25)) AS k)),
d AS (SELECT iteration, CAST(floor({UNIT.format(key="'6:' || iteration || ':' || k")} * n) AS BIGINT) AS i FROM g, n)
SELECT iteration, round(avg(c_acctbal), 4) + 0.0 AS value FROM d JOIN p USING (i) GROUP BY iteration""")
def sampling_distribution_mean(spark, d):
    return rounded(sampling.sampling_distribution_of("mean", T(spark, d, "customer"), "c_custkey", "c_acctbal", 25, 60, 6), 4)


@query("""WITH p AS (SELECT c_custkey, c_acctbal / 1000 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer), c AS (SELECT * FROM (VALUES (0, 0.0, 5.0), (1, 5.0, 12.0), (2, 8.0, 20.0)) AS v(k, cx, cy)),
d AS (SELECT c_custkey, k, cx, cy, (x - cx) ** 2 + (y - cy) ** 2 AS d, row_number() OVER (PARTITION BY c_custkey ORDER BY (x - cx) ** 2 + (y - cy) ** 2, k) AS place FROM p, c)
SELECT c_custkey, CAST(k AS INTEGER) AS cluster, round(d, 5) + 0.0 AS distance, cx + 0.0 AS centroid_x, cy + 0.0 AS centroid_y FROM d WHERE place = 1""")
def kmeans_members(spark, d):
    df = T(spark, d, "customer").select("c_custkey", F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")).alias("x"))
    model = KMeans.fit(df, "x", 3, iterations=0, start=[[0, 5], [5, 12], [8, 20]])
    made = model.members(df, "x").select("c_custkey", "cluster", "distance", F.get("centroid", F.lit(0)).alias("centroid_x"), F.get("centroid", F.lit(1)).alias("centroid_y"))
    return rounded(made, 5)


LETTERS = "AEINR"
COUNTS = ", ".join(f"CAST(len({{t}}) - len(replace({{t}}, '{c}', '')) AS DOUBLE)" for c in LETTERS)


@query(f"""WITH v AS (SELECT n_nationkey, n_name, [{COUNTS.format(t='n_name')}] AS v FROM nation), q AS (SELECT [{COUNTS.format(t="'UNITED KINGDOM'")}] AS q)
SELECT n_name AS label, round(CASE WHEN list_inner_product(v, v) = 0 THEN 0 ELSE list_inner_product(v, q) / sqrt(list_inner_product(v, v) * list_inner_product(q, q)) END, 5) + 0.0 AS score FROM v, q""")
def retrieve_by_text(spark, d):
    """Nations by the letters that they share with a text, which the index's embedder turns into a vector."""
    texts = T(spark, d, "nation").select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("text"), F.col("n_name").alias("label"))
    empty = texts.select("position", "label", F.array(F.lit(0.0)).alias("vector")).where(F.lit(False))
    count = lambda t, c: (F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("double")
    index = similarity.EmbeddingIndex(empty, lambda t: F.array(*(count(t, c) for c in LETTERS))).add(texts)
    return index.retrieve("UNITED KINGDOM", 25).select(F.explode("hits").alias("h")).select("h.label", r("h.score", 5).alias("score"))


@query("""WITH c AS (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT row_number() OVER (ORDER BY m) - 1 AS p, CAST(n AS DOUBLE) AS x FROM c),
z AS (SELECT CAST(2 ** ceil(log2(count(*))) AS BIGINT) AS n FROM s), b AS (SELECT unnest(range(0, (SELECT n FROM z))) AS k)
SELECT k AS bin, round(sqrt(sum(x * cos(2 * pi() * k * p / n)) ** 2 + sum(x * sin(2 * pi() * k * p / n)) ** 2), 4) + 0.0 AS magnitude, round(sum(x * cos(2 * pi() * k * p / n)) / any_value(n), 7) + 0.0 AS inverse FROM s, z, b GROUP BY k""")
def fourier_monthly(spark, d):
    """Transform, and inverse transform, of the number of orders by month, padded to a power of two."""
    months = T(spark, d, "orders").groupBy(F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("m")).agg(F.count("*").cast("double").alias("x"))
    series = signal.padded_rows(months.select((F.row_number().over(Window.orderBy("m")) - 1).alias("position"), "x"), "x", "position")  # a row a month
    found = signal.fourier(series, "x", "position").select("bin", "magnitude")
    back = signal.fourier_inverse(series, "x", "position").select(F.col("position").alias("bin"), F.col("value").alias("inverse"))
    return rounded(found.join(back, "bin"), 4, inverse=7)  # multiples of 1/128, which end within 7 digits: shorter roundings meet ties
