"""Queries of vectors, matrices, similarity, mathematics and texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from statloom.functions import linalg, polynomials, text
from statloom.functions import vectors as V
from statloom.functions.fractions import fraction_column
from statloom.operators import similarity
from statloom.operators.inverted import InvertedFile
from statloom.plans.registry import query, r, rounded
from statloom.session import shared_dir
from statloom.sources.files import table as T

QUERY = [((k * 37) % 11 - 5) / 10 for k in range(64)]
SQL_QUERY = f"{QUERY}::DOUBLE[]"
E_ = "embedding::DOUBLE[]"
NORM = f"sqrt(list_inner_product({E_}, {E_}))"
QNORM = f"sqrt(list_inner_product({SQL_QUERY}, {SQL_QUERY}))"
COSINE = f"list_inner_product({E_}, {SQL_QUERY}) / ({NORM} * {QNORM})"


def _vectors(spark, d):
    return T(spark, d, "embeddings").select("vec_id", "embedding", "label")


def _q():
    return V.literal(QUERY)


@query(f"SELECT vec_id, round(list_inner_product({E_}, {SQL_QUERY}), 5) + 0.0 AS dot, round({NORM}, 5) + 0.0 AS norm, round(sqrt(list_sum([(x[1] - x[2]) ** 2 for x in list_zip({E_}, {SQL_QUERY})])), 5) + 0.0 AS distance FROM embeddings")
def dot_norm_distance(spark, d):
    return rounded(_vectors(spark, d).select("vec_id", V.dot("embedding", _q()).alias("dot"), V.magnitude("embedding").alias("norm"), V.distance("embedding", _q()).alias("distance")), 5)


@query(f"SELECT vec_id, round({COSINE}, 5) + 0.0 AS similarity, round(degrees(acos({COSINE})), 4) + 0.0 AS degrees FROM embeddings")
def cosine_and_angle(spark, d):
    return rounded(similarity.cosine_similarities(_vectors(spark, d), "embedding", QUERY).select("vec_id", "similarity", V.angle_degrees("embedding", _q()).alias("degrees")), 5, degrees=4)


@query(f"SELECT row_number() OVER (ORDER BY {COSINE} DESC, vec_id) AS rank, vec_id, round({COSINE}, 5) + 0.0 AS score FROM embeddings QUALIFY rank <= 20")
def cosine_topk(spark, d):
    return rounded(similarity.most_similar(_vectors(spark, d), "embedding", "vec_id", QUERY, 20), 5)


def _elementwise(name: str, op: str, f) -> None:
    @query(f"SELECT vec_id, CAST(g.i - 1 AS INTEGER) AS position, round(CAST(embedding[g.i] AS DOUBLE) {op} ({SQL_QUERY})[g.i], 5) + 0.0 AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) g", name=f"elementwise_{name}")
    def elementwise(spark, d):
        df = _vectors(spark, d).select("vec_id", F.posexplode(f(F.col("embedding"), _q())).alias("position", "x"))
        return rounded(df, 5)


for _n, _op, _f in (("add", "+", V.add), ("subtract", "-", V.subtract), ("multiply", "*", V.multiply)):
    _elementwise(_n, _op, _f)


@query(f"SELECT vec_id, CAST(g.i - 1 AS INTEGER) AS position, round(({SQL_QUERY})[g.i] / (2 + CAST(embedding[g.i] AS DOUBLE)), 5) + 0.0 AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) g")
def elementwise_divide(spark, d):
    below = V.broadcast_add("embedding", 2.0)
    return rounded(_vectors(spark, d).select("vec_id", F.posexplode(V.divide(_q(), below)).alias("position", "x")), 5)


@query(f"""SELECT vec_id, CAST(g.i - 1 AS INTEGER) AS position, round(2 * CAST(embedding[g.i] AS DOUBLE) + 1, 5) + 0.0 AS scaled, round((1 - CAST(embedding[g.i] AS DOUBLE)) / 4, 5) + 0.0 AS shifted, round(CAST(embedding[g.i] AS DOUBLE) / {NORM}, 5) + 0.0 AS unit
FROM embeddings, (SELECT unnest(range(1, 65)) AS i) g""")
def broadcast_and_normalized(spark, d):
    x = F.col("embedding")
    parts = F.arrays_zip(V.broadcast_add(V.broadcast_multiply(x, 2), 1).alias("scaled"), V.broadcast_divide(V.scalar_subtract(1, x), 4).alias("shifted"), V.normalized(x).alias("unit"))
    return rounded(_vectors(spark, d).select("vec_id", F.posexplode(parts).alias("position", "p")).select("vec_id", "position", "p.*"), 5)


@query(f"""WITH s AS (SELECT vec_id, embedding, list_inner_product({E_}, {SQL_QUERY}) AS d, {QNORM} AS n FROM embeddings)
SELECT vec_id, CAST(g.i - 1 AS INTEGER) AS position, round(d / n, 5) + 0.0 AS scalar, round(({SQL_QUERY})[g.i] * d / (n * n), 5) + 0.0 AS projection, round(CAST(embedding[g.i] AS DOUBLE) - ({SQL_QUERY})[g.i] * d / (n * n), 5) + 0.0 AS orthogonal
FROM s, (SELECT unnest(range(1, 65)) AS i) g""")
def projections(spark, d):
    parts = F.arrays_zip(V.vector_projection("embedding", _q()).alias("projection"), V.orthogonal_component("embedding", _q()).alias("orthogonal"))
    df = _vectors(spark, d).select("vec_id", V.scalar_projection("embedding", _q()).alias("scalar"), F.posexplode(parts).alias("position", "p"))
    return rounded(df.select("vec_id", "position", "scalar", "p.*"), 5)


@query(f"""WITH n AS (SELECT vec_id, {E_} AS e, {NORM} AS n FROM embeddings WHERE {NORM} > 0)
SELECT a.vec_id AS id1, b.vec_id AS id2, round(list_inner_product(a.e, b.e) / (a.n * b.n), 6) + 0.0 AS similarity FROM n a JOIN n b ON a.vec_id < b.vec_id WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.4""")
def near_duplicate_vectors(spark, d):
    """Of whole vectors, at a threshold that related ones reach as well."""
    return rounded(similarity.find_duplicates(_vectors(spark, d), "embedding", "vec_id", 0.4))


@query(f"""WITH n AS (SELECT vec_id, {E_} AS e, {NORM} AS n FROM embeddings WHERE {NORM} > 0)
SELECT a.vec_id AS id1, b.vec_id AS id2, round(list_inner_product(a.e, b.e) / (a.n * b.n), 6) + 0.0 AS similarity FROM n a JOIN n b ON a.vec_id < b.vec_id WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95""")
def near_duplicate_embeddings(spark, d):
    """Of whole vectors, at the default threshold."""
    return rounded(similarity.find_duplicates(_vectors(spark, d), "embedding", "vec_id"))


@query(f"""WITH n AS (SELECT vec_id, label, {E_} AS e, {NORM} AS n FROM embeddings)
SELECT a.label, round(avg(list_inner_product(a.e, b.e) / (a.n * b.n)), 6) + 0.0 AS cohesion FROM n a JOIN n b ON a.vec_id < b.vec_id AND a.label = b.label GROUP BY a.label""")
def cluster_cohesion_by_label(spark, d):
    return rounded(similarity.cluster_cohesion(_vectors(spark, d), "embedding", ("label",)))


@query("SELECT min(len(embedding)) = max(len(embedding)) AS valid FROM embeddings")
def valid_dimensions(spark, d):
    return similarity.valid_dimensions(_vectors(spark, d), "embedding")


@query(f"""WITH s AS (SELECT vec_id, label, {COSINE} AS score FROM embeddings), t AS (SELECT avg(score) AS mean, stddev_samp(score) AS deviation, max(score) AS top FROM s)
SELECT round(mean, 5) + 0.0 AS mean, round(deviation, 5) + 0.0 AS deviation, round(top, 5) + 0.0 AS top_score, round((top - mean) / deviation, 4) + 0.0 AS top_z, top >= 0.9 OR (top - mean) / deviation >= 2.5 AS above FROM t""")
def retrieval_gate(spark, d):
    scores = _vectors(spark, d).select(F.col("vec_id").alias("position"), "label", similarity.cosine_to("embedding", QUERY).alias("score"))
    made = similarity.above_gate(similarity.retrieve(scores, 5), 0.9, 2.5).drop("hits")
    return rounded(made, 5, top_z=4)


@query("""WITH x AS (SELECT vec_id, CAST(g.i - 1 AS INTEGER) AS position, CAST(embedding[g.i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i) g), m AS (SELECT *, max(v) OVER (PARTITION BY vec_id) AS top FROM x)
SELECT vec_id, position, round(exp(v - top) / sum(exp(v - top)) OVER (PARTITION BY vec_id), 6) + 0.0 AS softmax, round(1 / (1 + exp(-v)), 6) + 0.0 AS sigmoid FROM m""")
def softmax_sigmoid(spark, d):
    parts = F.arrays_zip(V.softmax("embedding").alias("softmax"), V.sigmoid("embedding").alias("sigmoid"))
    return rounded(_vectors(spark, d).select("vec_id", F.posexplode(parts).alias("position", "p")).select("vec_id", "position", "p.*"))


@query("SELECT vec_id, CAST(n AS INTEGER) AS above, CAST(first AS INTEGER) AS first, round(total, 5) + 0.0 AS total FROM (SELECT vec_id, len(list_filter(e, lambda x: x > 0.1)) AS n, list_position([x > 0.1 for x in e], true) - 1 AS first, coalesce(list_sum(list_filter(e, lambda x: x > 0.1)), 0) AS total FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))")
def vector_masks(spark, d):
    mask = V.compare("embedding", ">", 0.1)
    kept = V.masked(V.as_doubles("embedding"), mask)
    made = _vectors(spark, d).select("vec_id", F.size(kept).alias("above"), F.coalesce(F.get(V.true_indices(mask), F.lit(0)), F.lit(-1)).alias("first"), F.aggregate(kept, F.lit(0.0), lambda s, x: s + x).alias("total"))
    return rounded(made, 5)


@query("SELECT i, j, round(sum(a.v * b.v), 4) + 0.0 AS v FROM (SELECT l_linenumber AS i, l_returnflag AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) a JOIN (SELECT l_returnflag AS k, l_linestatus AS j, sum(l_tax) AS v FROM lineitem GROUP BY 1, 2) b USING (k) GROUP BY i, j")
def matrix_product_tall(spark, d):
    li = T(spark, d, "lineitem")
    a = li.groupBy(F.col("l_linenumber").alias("i"), F.col("l_returnflag").alias("j")).agg(F.sum("l_quantity").alias("v"))
    b = li.groupBy(F.col("l_returnflag").alias("i"), F.col("l_linestatus").alias("j")).agg(F.sum("l_tax").alias("v"))
    return rounded(V.multiply_tall(a, b), 4)


def _regions(spark, d):
    """A 2 x 3 and a 3 x 2 matrix for every region."""
    k = F.col("r_regionkey").cast("double")
    return T(spark, d, "region").select("r_regionkey", F.array(F.array(k, F.lit(1.0), F.lit(2.0)), F.array(F.lit(0.5), k + 1, F.lit(-1.0))).alias("a"), F.array(F.array(F.lit(1.0), k), F.array(F.lit(2.0), F.lit(0.0)), F.array(k, F.lit(3.0))).alias("b"))


@query("""WITH r AS (SELECT r_regionkey, CAST(r_regionkey AS DOUBLE) AS k FROM region)
SELECT r_regionkey, k + 2 + 2 * k AS p11, k * k + 6 AS p12, 0.5 + 2 * (k + 1) - k AS p21, 0.5 * k - 3 AS p22, k + 1 AS t22, k * 1 + 1 * 2 + 2 * 3 AS mv1, CAST(6 AS INTEGER) AS cells FROM r""")
def small_matrices(spark, d):
    at = lambda m, i, j: F.get(F.get(m, F.lit(i)), F.lit(j))
    p, t = V.matrix_product("a", "b"), V.transpose("a")
    mv = V.matrix_vector("a", V.literal([1, 2, 3]))
    return _regions(spark, d).select("r_regionkey", at(p, 0, 0).alias("p11"), at(p, 0, 1).alias("p12"), at(p, 1, 0).alias("p21"), at(p, 1, 1).alias("p22"), at(t, 1, 1).alias("t22"), F.get(mv, F.lit(0)).alias("mv1"), V.cells("a").alias("cells"))


@query("""WITH r AS (SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) + 1 AS k FROM nation)
SELECT n_nationkey, round(k * 3 - 2 * 1, 6) + 0.0 AS determinant, round((5 * 3 - 2 * 10) / (k * 3 - 2), 6) + 0.0 AS x1, round((k * 10 - 5) / (k * 3 - 2), 6) + 0.0 AS x2, round(3 / (k * 3 - 2), 6) + 0.0 AS inverse11 FROM r""")
def solve_two_by_two(spark, d):
    k = F.col("n_nationkey").cast("double") + 1
    m = T(spark, d, "nation").select("n_nationkey", F.array(F.array(k, F.lit(2.0)), F.array(F.lit(1.0), F.lit(3.0))).alias("m"), F.array(F.lit(5.0), F.lit(10.0)).alias("b"))
    made = m.select("n_nationkey", linalg.column(linalg.determinant)("m").alias("determinant"), linalg.column(linalg.solve, "array<double>")("m", "b").alias("x"), linalg.column(linalg.inverse, "array<array<double>>")("m").alias("i"))
    return rounded(made.select("n_nationkey", "determinant", F.get("x", F.lit(0)).alias("x1"), F.get("x", F.lit(1)).alias("x2"), F.get(F.get("i", F.lit(0)), F.lit(0)).alias("inverse11")))


def _laplace(n):
    """The determinant of m[i][j], i and j from 1, as a sum over permutations in SQL."""
    from itertools import permutations

    signs = {p: (-1) ** sum(p[i] > p[j] for i in range(n) for j in range(i + 1, n)) for p in permutations(range(n))}
    return " + ".join(f"({s}) * " + " * ".join(f"m[{i + 1}][{j + 1}]" for i, j in enumerate(p)) for p, s in signs.items())


@query(f"""WITH e AS (SELECT vec_id, {E_} AS e FROM embeddings), m AS (SELECT vec_id, [[e[i * 4 + j + 1] + CASE WHEN i = j THEN 1.5 ELSE 0 END for j in range(0, 4)] for i in range(0, 4)] AS m FROM e)
SELECT vec_id, CAST(0 AS DOUBLE) AS error, round({_laplace(4)}, 5) + 0.0 AS from_pivots, round(ln(abs({_laplace(4)})), 5) + 0.0 AS log_abs FROM m""")
def lu_reconstruct(spark, d):
    """Largest error of P A - L U for 4 x 4 matrices of each embedding's components, and determinants from the pivots."""
    row = lambda i: F.array(*(F.get("embedding", F.lit(i * 4 + j)).cast("double") + F.lit(1.5 if i == j else 0.0) for j in range(4)))
    m = _vectors(spark, d).select("vec_id", F.array(*map(row, range(4))).alias("m"))

    def error(a):
        f = linalg.lu(a)
        return float(abs(a[f.permutation] - f.lower @ f.upper).max())

    made = m.select("vec_id", linalg.column(error)("m").alias("error"), linalg.column(lambda a: linalg.lu(a).determinant)("m").alias("from_pivots"), linalg.column(lambda a: linalg.log_determinant(a).log_abs)("m").alias("log_abs"))
    return rounded(made, 5)


@query("""SELECT c_custkey, round(sin(x), 6) + 0.0 AS sin, round(cos(x), 6) + 0.0 AS cos, round(tan(x), 3) + 0.0 AS tan, floor(x) + 0.0 AS floor, ceil(x) + 0.0 AS ceil, round(x) + 0.0 AS round,
    CASE WHEN x = 0 THEN '-inf' WHEN x < 0 THEN 'nan' ELSE CAST(CAST(round(ln(x) * 1000) AS BIGINT) AS VARCHAR) END AS log, round(exp(x / 1000), 4) + 0.0 AS exp, CASE WHEN x < 0 THEN NULL ELSE round(sqrt(x), 6) + 0.0 END AS sqrt, round(x * x, 3) + 0.0 AS square
FROM (SELECT c_custkey, CASE WHEN c_custkey % 100 = 0 THEN 0 ELSE c_acctbal END AS x FROM customer)""")
def elementwise_math(spark, d):
    x = F.when(F.col("c_custkey") % 100 == 0, 0.0).otherwise(F.col("c_acctbal"))
    df = T(spark, d, "customer").select("c_custkey", x.alias("x"))
    f = lambda n: V.MATH[n](F.col("x"))
    log = f("log")
    shown = F.when(F.isnan(log), "nan").when(log == float("-inf"), "-inf").otherwise(F.round(log * 1000).cast("long").cast("string"))
    return df.select("c_custkey", r(f("sin")).alias("sin"), r(f("cos")).alias("cos"), r(f("tan"), 3).alias("tan"), (f("floor") + 0.0).alias("floor"), (f("ceil") + 0.0).alias("ceil"), (f("round") + 0.0).alias("round"), shown.alias("log"), r(V.MATH["exp"](F.col("x") / 1000), 4).alias("exp"), F.when(~F.isnan(f("sqrt")), r(f("sqrt"))).alias("sqrt"), r(f("square"), 3).alias("square"))


@query("SELECT p_partkey, round(3 - 2 * x + 0.5 * x * x, 4) + 0.0 AS value, round(-2 + x, 4) + 0.0 AS slope FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x FROM part)")
def polynomial_values(spark, d):
    p = polynomials.Polynomial([3, -2, 0.5])
    x = F.col("p_size").cast("double")
    return rounded(T(spark, d, "part").select("p_partkey", polynomials.evaluate(V.literal(list(p.coefficients)), x).alias("value"), p.derivative()(x).alias("slope")), 4)


@query("SELECT round(regr_intercept(p_retailprice, p_size), 4) + 0.0 AS c0, round(regr_slope(p_retailprice, p_size), 4) + 0.0 AS c1 FROM part")
def polyfit_line(spark, d):
    p = polynomials.polyfit(T(spark, d, "part"), "p_size", "p_retailprice", 1)
    return rounded(spark.range(1).select(F.lit(p.coefficients[0]).alias("c0"), F.lit(p.coefficients[1]).alias("c1")), 4)


@query("SELECT p_size, CAST(p_size // gcd(p_size, 24) AS BIGINT) AS numerator, CAST(24 // gcd(p_size, 24) AS BIGINT) AS denominator FROM part GROUP BY p_size")
def fractions(spark, d):
    sizes = T(spark, d, "part").select("p_size").distinct()
    return sizes.select("p_size", fraction_column(F.col("p_size") / 24).alias("f")).select("p_size", "f.*")


@query(f"""WITH e AS (SELECT vec_id, {E_} AS e FROM embeddings) SELECT vec_id, round(list_inner_product(e, [CAST(1 + i * 0.25 AS DOUBLE) for i in range(0, 64)]), 4) + 0.0 AS stepped,
round(list_inner_product(e, [-1 + CAST(i AS DOUBLE) * 2 / 63 for i in range(0, 64)]), 5) + 0.0 AS spaced, round(list_sum(e) * 2.5, 5) + 0.0 AS filled, round(e[2], 6) + 0.0 AS on_diagonal, CAST(0 AS DOUBLE) AS off_diagonal FROM e""")
def generated_vectors(spark, d):
    """Products of the embeddings with generated vectors, and the first three components of each on a diagonal."""
    diagonal = V.diagonal(F.slice("embedding", 1, 3))
    at = lambda i, j: F.get(F.get(diagonal, F.lit(i)), F.lit(j))
    products = {"stepped": V.arange(1, 17, 0.25), "spaced": V.linspace(-1, 1, 64), "filled": V.full(64, 2.5)}
    made = _vectors(spark, d).select("vec_id", *(V.dot("embedding", v).alias(n) for n, v in products.items()), at(1, 1).alias("on_diagonal"), at(1, 2).alias("off_diagonal"))
    return rounded(made, 5, stepped=4, on_diagonal=6)


# Texts

WORDS = r"list_filter(list_transform(regexp_split_to_array(lower(text), '[\s\p{Z}\x{85}]+'), lambda w: regexp_replace(w, '^\p{P}+|\p{P}+$', '', 'g')), lambda w: w <> '')"


@query(f"SELECT doc_id, CAST(len(w) AS INTEGER) AS n, CAST(len(list_distinct(w)) AS INTEGER) AS n_distinct FROM (SELECT doc_id, {WORDS} AS w FROM documents)")
def tokenize_counts(spark, d):
    df = T(spark, d, "documents").select("doc_id", text.tokenize("text").alias("w"))
    return df.select("doc_id", F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("n_distinct"))


@query(r"SELECT word, count(*) AS count FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[\s\p{Z}\x{85}]+'), lambda w: w <> '')) AS word FROM benchmark) GROUP BY word")
def tokenize_keep_punctuation(spark, d):
    return T(spark, d, "benchmark").select(F.explode(text.tokenize("text", remove_punctuation=False)).alias("word")).groupBy("word").agg(F.count("*").alias("count"))


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS index, chunk FROM (SELECT doc_id, i, trim(l[i], ' \t') AS chunk FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)) WHERE chunk <> ''")
def chunk_lines(spark, d):
    return text.chunked(T(spark, d, "documents"), "text", text.lines, "doc_id")


@query(f"""WITH v AS (SELECT DISTINCT word, CAST(length(word) AS DOUBLE) AS a, CAST(ascii(word) AS DOUBLE) AS b FROM (SELECT unnest({WORDS}) AS word FROM benchmark)),
t AS (SELECT doc_id, unnest({WORDS}) AS word FROM documents)
SELECT doc_id, count(*) AS known, round(avg(a), 6) + 0.0 AS mean0, round(avg(b), 6) + 0.0 AS mean1 FROM t JOIN v USING (word) GROUP BY doc_id""")
def vocabulary_embedding(spark, d):
    words = T(spark, d, "benchmark").select(F.explode(text.tokenize("text")).alias("word")).distinct()
    vocabulary = words.select("word", F.array(F.length("word").cast("double"), F.ascii("word").cast("double")).alias("vector"))
    docs = T(spark, d, "documents").select("doc_id", text.tokenize("text").alias("tokens"))
    found = text.embed_tokens(docs, "tokens", vocabulary, "doc_id")
    return rounded(found.groupBy("doc_id").agg(F.count("*").alias("known"), F.avg(F.get("vector", F.lit(0))).alias("mean0"), F.avg(F.get("vector", F.lit(1))).alias("mean1")))


@query(f"""WITH s AS (SELECT vec_id, label, {COSINE} AS score FROM embeddings WHERE label <> 3), t AS (SELECT avg(score) AS mean, stddev_samp(score) AS d, max(score) AS top FROM s)
SELECT label, round(score, 5) + 0.0 AS score, round(mean, 5) + 0.0 AS mean, round((top - mean) / d, 4) + 0.0 AS top_z FROM s, t ORDER BY s.score DESC, vec_id LIMIT 5""")
def embedding_index(spark, d):
    """An index of labelled vectors with entries added, removed and retrieved."""
    entries = _vectors(spark, d).select(F.col("vec_id").alias("position"), "label", F.col("embedding").alias("vector"))
    index = similarity.EmbeddingIndex(entries, lambda t: F.array(F.length(t).cast("double"))).remove(3)
    hits = index.retrieve(QUERY, 5)
    return hits.select(F.explode("hits").alias("h"), "mean", "top_z").select("h.label", r("h.score", 5).alias("score"), r("mean", 5).alias("mean"), r("top_z", 4).alias("top_z"))


HITS = f"""WITH e AS (SELECT vec_id, label, {E_} AS e, {NORM} AS n FROM embeddings), q AS (SELECT vec_id AS query, e AS q, n AS m FROM e WHERE vec_id % 20 = 0),
s AS (SELECT query, vec_id, label, CASE WHEN n > 0 AND m > 0 THEN list_inner_product(e, q) / (n * m) ELSE 0 END AS score FROM q, e)"""


def _asked(spark, d):
    """The queries of a search, every twentieth row, and an index of all rows as an inverted file."""
    vectors = _vectors(spark, d)
    entries = vectors.select(F.col("vec_id").alias("position"), "label", F.col("embedding").alias("vector"))
    index = InvertedFile.build(entries, f"{shared_dir(spark)}/statloom/inverted-{uuid.uuid4().hex}")
    return index, vectors.where("vec_id % 20 = 0")


@query(HITS + " SELECT query, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, vec_id) AS rank, vec_id AS position, label, round(score, 5) + 0.0 AS score FROM s QUALIFY rank <= 10")
def inverted_file_search(spark, d):
    """The ten best entries of many queries at once, from the cells that can hold them."""
    index, asked = _asked(spark, d)
    return rounded(index.search(asked, "vec_id", "embedding", 10), 5)


@query(HITS + " SELECT query, round(avg(score), 5) + 0.0 AS mean, round(stddev_samp(score), 5) + 0.0 AS deviation, round(max(score), 5) + 0.0 AS top_score, round((max(score) - avg(score)) / stddev_samp(score), 3) + 0.0 AS top_z FROM s GROUP BY query")
def inverted_file_retrieval(spark, d):
    """Mean, deviation and the best score of each query over all entries."""
    index, asked = _asked(spark, d)
    return rounded(index.retrieve(asked, "vec_id", "embedding", 3).drop("hits"), 5, top_z=3)
