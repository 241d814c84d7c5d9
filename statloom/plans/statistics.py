"""Queries of scalar statistics, groups, frequencies, filters and order."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.core import joined, with_position
from statloom.operators import aggregates as A
from statloom.operators import frame, groups
from statloom.operators.series import sorted_indices
from statloom.plans.registry import query, r, rounded
from statloom.sources.files import table as T

QUARTILES = "quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3"


@query("""
SELECT event_type, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS std,
    round(min(value), 6) + 0.0 AS low, round(quantile_cont(value, 0.25), 6) + 0.0 AS q1, round(quantile_cont(value, 0.5), 6) + 0.0 AS median,
    round(quantile_cont(value, 0.75), 6) + 0.0 AS q3, round(quantile_cont(value, 0.95), 6) + 0.0 AS p95, round(quantile_cont(value, 0.99), 6) + 0.0 AS p99,
    round(max(value), 6) + 0.0 AS high, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) + 0.0 AS iqr
FROM events GROUP BY event_type
""")
def event_summary(spark, d):
    events = T(spark, d, "events").select("event_type", "value")
    shares = A.percentiles(events, "value", ("event_type",), low=0, q1=25, median=50, q3=75, p95=95, p99=99, high=100)
    moments = events.groupBy("event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return rounded(joined(moments, shares.withColumn("iqr", F.col("q3") - F.col("q1")), ("event_type",), "left"))


@query("""
WITH u AS (UNPIVOT (SELECT CAST(o_totalprice AS DOUBLE) AS o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders) ON o_totalprice, o_custkey INTO NAME col VALUE value)
SELECT CASE WHEN col = 'o_totalprice' THEN 0 ELSE 1 END AS ordinal, col AS column, count(value) AS count, round(avg(value), 2) + 0.0 AS mean, round(stddev_samp(value), 2) + 0.0 AS std, round(min(value), 2) + 0.0 AS min,
    round(quantile_cont(value, 0.25), 2) + 0.0 AS q1, round(quantile_cont(value, 0.5), 2) + 0.0 AS median, round(quantile_cont(value, 0.75), 2) + 0.0 AS q3, round(max(value), 2) + 0.0 AS max,
    round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 2) + 0.0 AS iqr
FROM u GROUP BY col
""")
def frame_summary(spark, d):
    return rounded(A.frame_summary(T(spark, d, "orders"), ["o_totalprice", "o_custkey"]), 2)


@query("""
SELECT round(min(p_retailprice), 4) + 0.0 AS min, round(quantile_cont(p_retailprice, 0.25), 4) + 0.0 AS q1, round(quantile_cont(p_retailprice, 0.5), 4) + 0.0 AS median,
    round(quantile_cont(p_retailprice, 0.75), 4) + 0.0 AS q3, round(max(p_retailprice), 4) + 0.0 AS max, round(quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25), 4) + 0.0 AS iqr
FROM part
""")
def quartiles_part_price(spark, d):
    return rounded(A.quartiles_by(T(spark, d, "part"), "p_retailprice"), 4)


@query("""
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) + 0.0 AS p5, round(quantile_cont(l_extendedprice, 0.9), 4) + 0.0 AS p90, CAST(NULL AS DOUBLE) AS outside FROM lineitem GROUP BY l_returnflag
""")
def percentile_list(spark, d):
    return rounded(A.percentiles(T(spark, d, "lineitem"), "l_extendedprice", ("l_returnflag",), p5=5, p90=90, outside=101), 4)


@query("SELECT event_type, round(stddev_samp(value) / sqrt(count(value)), 6) + 0.0 AS se FROM events GROUP BY event_type")
def std_error_by_type(spark, d):
    return rounded(T(spark, d, "events").groupBy("event_type").agg(A.standard_error("value").alias("se")))


@query("""
SELECT event_type, round(var_pop(value), 4) + 0.0 AS v0, round(var_samp(value), 4) + 0.0 AS v1, round(var_pop(value) * count(value) / (count(value) - 2), 4) + 0.0 AS v2 FROM events GROUP BY event_type
""")
def variance_ddof(spark, d):
    return rounded(T(spark, d, "events").groupBy("event_type").agg(*(A.variance("value", k).alias(f"v{k}") for k in (0, 1, 2))), 4)


@query("SELECT r_regionkey, count(*) AS n, CAST(NULL AS DOUBLE) AS variance, CAST(NULL AS DOUBLE) AS skew FROM region GROUP BY r_regionkey")
def undefined_statistics(spark, d):
    x = F.col("r_regionkey")
    return T(spark, d, "region").groupBy(x).agg(F.count("*").alias("n"), A.variance(x).alias("variance"), A.skewness(x).alias("skew"))


@query("""
WITH m AS (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS mu FROM events),
c AS (SELECT event_type, count(*) AS n, avg((value - mu) ** 2) AS m2, avg((value - mu) ** 3) AS m3, avg((value - mu) ** 4) AS m4 FROM m GROUP BY event_type)
SELECT event_type, round(m3 / m2 ** 1.5, 6) + 0.0 AS skew, round(m4 / m2 ** 2 - 3, 6) + 0.0 AS kurt,
    round(m3 / m2 ** 1.5 * sqrt(n * (n - 1)) / (n - 2), 6) + 0.0 AS skew_unbiased, round((n - 1) * ((n + 1) * (m4 / m2 ** 2 - 3) + 6) / ((n - 2) * (n - 3)), 6) + 0.0 AS kurt_unbiased
FROM c
""")
def skewness_kurtosis(spark, d):
    return rounded(T(spark, d, "events").groupBy("event_type").agg(A.skewness("value").alias("skew"), A.kurtosis("value").alias("kurt"), A.skewness("value", bias=False).alias("skew_unbiased"), A.kurtosis("value", bias=False).alias("kurt_unbiased")))


@query("""
WITH m AS (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS mu FROM events),
c AS (SELECT event_type, count(*) AS n, avg((value - mu) ** 2) AS m2, avg((value - mu) ** 3) AS m3, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM m GROUP BY event_type),
s AS (SELECT event_type, m3 / m2 ** 1.5 * sqrt(n * (n - 1)) / (n - 2) AS moment, (q3 - 2 * q2 + q1) / (q3 - q1) AS bowley FROM c),
v AS (SELECT *, CASE WHEN abs(moment) < 0.5 THEN 0 ELSE sign(moment) END AS a, CASE WHEN abs(bowley) < 0.1 THEN 0 ELSE sign(bowley) END AS b FROM s)
SELECT event_type, round(moment, 6) + 0.0 AS moment, round(bowley, 6) + 0.0 AS bowley, CASE WHEN a = b THEN 'agree' WHEN a * b < 0 THEN 'direction' ELSE 'mixed' END AS agreement FROM v
""")
def bowley_report(spark, d):
    return rounded(A.skewness_report(T(spark, d, "events"), "value", ("event_type",)))


@query("""
WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
SELECT round(avg(CASE WHEN abs(value - m) <= s THEN 1.0 ELSE 0 END), 6) + 0.0 AS within1, round(avg(CASE WHEN abs(value - m) <= 2 * s THEN 1.0 ELSE 0 END), 6) + 0.0 AS within2, round(avg(CASE WHEN abs(value - m) <= 3 * s THEN 1.0 ELSE 0 END), 6) + 0.0 AS within3 FROM events, s
""")
def empirical_rule(spark, d):
    return rounded(A.empirical_rule(T(spark, d, "events"), "value"))


@query("WITH s AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer) SELECT c_custkey, abs(c_acctbal - m) > 1.5 * s AS outlier FROM customer, s")
def outlier_mask(spark, d):
    return A.outlier_mask(T(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 1.5).select("c_custkey", "outlier")


@query("SELECT round((5000 - avg(c_acctbal)) / stddev_samp(c_acctbal), 6) + 0.0 AS z FROM customer")
def zscore_value(spark, d):
    return rounded(T(spark, d, "customer").agg(A.z_score(5000, "c_acctbal").alias("z")))


@query("WITH c AS (SELECT p_size, count(*) AS count FROM part GROUP BY p_size) SELECT p_size, count FROM c WHERE count = (SELECT max(count) FROM c)")
def modes(spark, d):
    return A.modes(T(spark, d, "part"), "p_size")


@query("""
SELECT event_type, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total, CAST(min(event_id) FILTER (value = low) AS BIGINT) AS arg_min, CAST(min(event_id) FILTER (value = high) AS BIGINT) AS arg_max
FROM (SELECT *, min(value) OVER w AS low, max(value) OVER w AS high FROM events WINDOW w AS (PARTITION BY event_type)) GROUP BY event_type
""")
def argmin_argmax(spark, d):
    total = A.total(F.col("value").cast("decimal(18,2)")).cast("double")
    return T(spark, d, "events").groupBy("event_type").agg(total.alias("total"), A.arg_min("value", "event_id").alias("arg_min"), A.arg_max("value", "event_id").alias("arg_max"))


@query("SELECT round(product(1 + r_regionkey), 6) + 0.0 AS product, CAST(0 AS DOUBLE) AS nothing, CAST(0 AS BIGINT) AS no_sum FROM region")
def product_of_nothing(spark, d):
    x = F.col("r_regionkey")
    none = F.when(F.lit(False), x)
    return T(spark, d, "region").agg(r(A.product(x + 1)).alias("product"), A.product(none).alias("nothing"), A.total(none).cast("long").alias("no_sum"))


@query("SELECT round(quantile_cont(c_acctbal, 0.05), 4) + 0.0 AS lower, round(quantile_cont(c_acctbal, 0.95), 4) + 0.0 AS upper FROM customer")
def percentile_ci(spark, d):
    return rounded(A.percentile_interval_of(T(spark, d, "customer"), "c_acctbal", 0.9), 4)


@query("SELECT round(100 * (sum(CASE WHEN p_retailprice < 1500 THEN 1.0 ELSE 0 END) + sum(CASE WHEN p_retailprice = 1500 THEN 1.0 ELSE 0 END) / 2) / count(*), 6) + 0.0 AS rank FROM part")
def percentile_rank_of(spark, d):
    return rounded(T(spark, d, "part").agg(A.percentile_rank(1500, "p_retailprice").alias("rank")))


@query("SELECT p_partkey, round(100 * (rank() OVER (ORDER BY p_size) - 1 + count(*) OVER (PARTITION BY p_size) / 2.0) / count(*) OVER (), 6) + 0.0 AS rank FROM part")
def mid_percentile_rank(spark, d):
    return rounded(A.percentile_ranks(T(spark, d, "part").select("p_partkey", "p_size"), "p_size").select("p_partkey", "rank"))


@query("SELECT label, CAST(g.i - 1 AS INTEGER) AS position, round(avg(CAST(embedding[g.i] AS DOUBLE)), 6) + 0.0 AS mean FROM embeddings, (SELECT unnest(range(1, 65)) AS i) g GROUP BY label, g.i")
def mean_vector_by_label(spark, d):
    return rounded(A.mean_vector(T(spark, d, "embeddings"), "embedding", ("label",)))


# Groups


def _group_query(method: str, sql: str) -> None:
    @query(f"SELECT l_returnflag AS category, round({sql}, 4) + 0.0 AS value FROM lineitem GROUP BY l_returnflag", name=f"group_{method}")
    def grouped(spark, d):
        return rounded(groups.grouped_data(T(spark, d, "lineitem"), "l_returnflag", "l_quantity", method), 4)


for _m, _sql in (("sum", "sum(l_quantity)"), ("mean", "avg(l_quantity)"), ("count", "CAST(count(l_quantity) AS DOUBLE)"), ("min", "min(l_quantity)"), ("max", "max(l_quantity)"), ("percentage", "sum(l_quantity) * 100 / sum(sum(l_quantity)) OVER ()")):
    _group_query(_m, _sql)


@query("SELECT CAST(quality AS INTEGER) AS quality, count(*) AS count FROM labels WHERE quality IS NOT NULL GROUP BY quality")
def class_distribution(spark, d):
    return groups.class_distribution(T(spark, d, "labels"), "quality")


@query("WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality) SELECT round(max(n) / min(n), 6) + 0.0 AS ratio FROM c")
def imbalance_ratio(spark, d):
    return rounded(groups.imbalance_ratio(T(spark, d, "labels"), "quality"))


@query("SELECT p_size AS value, count(*) AS count FROM part GROUP BY p_size")
def value_counts(spark, d):
    return groups.value_counts(T(spark, d, "part"), "p_size")


@query("SELECT CAST(l_quantity AS DOUBLE) AS value, count(*) AS count FROM lineitem GROUP BY l_quantity")
def distinct_counts(spark, d):
    return groups.distinct_counts(T(spark, d, "lineitem"), "l_quantity")


@query("SELECT DISTINCT p_brand FROM part")
def distinct_sorted(spark, d):
    return groups.distinct_sorted(T(spark, d, "part"), "p_brand")


@query("SELECT DISTINCT o_orderpriority FROM orders")
def unique_column(spark, d):
    return frame.unique(T(spark, d, "orders"), "o_orderpriority")


@query("SELECT l_discount AS value, round(count(*) / (SELECT count(*) FROM lineitem), 6) + 0.0 AS probability FROM lineitem GROUP BY l_discount")
def frequency_distribution(spark, d):
    made = groups.frequency_distribution(T(spark, d, "lineitem"), "l_discount")
    return made.select("value", r("probability").alias("probability"))


@query("SELECT round(avg(CASE WHEN l_discount = 0.05 THEN 1.0 ELSE 0 END), 6) + 0.0 AS probability FROM lineitem")
def probability_of(spark, d):
    return rounded(groups.probability_of(T(spark, d, "lineitem"), "l_discount", 0.05))


@query("""
SELECT a.s AS row, b.p AS column, count(o_orderkey) AS count FROM (SELECT DISTINCT o_orderstatus AS s FROM orders) a CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders) b
LEFT JOIN orders o ON o.o_orderstatus = a.s AND o.o_orderpriority = b.p GROUP BY a.s, b.p
""")
def contingency(spark, d):
    return groups.contingency(T(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("SELECT o_orderstatus AS row, o_orderpriority AS column, count(*) AS count FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def contingency_cube(spark, d):
    return groups.contingency_margins(T(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("""
SELECT 'row' AS side, o_orderstatus AS label, count(*) AS count FROM orders GROUP BY 2 UNION ALL SELECT 'column', o_orderpriority, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'all', NULL, count(*) FROM orders
""")
def contingency_totals(spark, d):
    t = groups.contingency(T(spark, d, "orders"), "o_orderstatus", "o_orderpriority")
    rows = groups.row_totals(t).select(F.lit("row").alias("side"), F.col("row").alias("label"), "count")
    columns = groups.column_totals(t).select(F.lit("column").alias("side"), F.col("column").alias("label"), "count")
    return rows.union(columns).union(groups.grand_total(t).select(F.lit("all").alias("side"), F.lit(None).cast("string").alias("label"), "count"))


def _share_query(name: str, over: str) -> None:
    @query(f"SELECT o_orderstatus AS row, o_orderpriority AS column, round(count(*) / sum(count(*)) OVER ({over}), 6) + 0.0 AS probability FROM orders GROUP BY 1, 2", name=name)
    def share(spark, d):
        return rounded(getattr(groups, name)(groups.contingency(T(spark, d, "orders"), "o_orderstatus", "o_orderpriority")))


for _n, _over in (("joint_distribution", ""), ("conditional_by_row", "PARTITION BY o_orderstatus"), ("conditional_by_column", "PARTITION BY o_orderpriority")):
    _share_query(_n, _over)


# Filters, masks, order

NANS = "CASE WHEN event_id % 97 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END"


def _with_nans(spark, d):
    return T(spark, d, "events").select("event_id", "event_type", F.expr(NANS).alias("x"))


@query(f"SELECT event_id, event_type FROM (SELECT *, {NANS} AS x FROM events) WHERE (x > 100 AND NOT isnan(x) AND x <= 300) OR NOT event_type IN ('view', 'click')")
def mask_and_or_not(spark, d):
    df = _with_nans(spark, d)
    return frame.filtered(df, (frame.greater("x", 100) & frame.less_equal("x", 300)) | ~F.col("event_type").isin("view", "click")).select("event_id", "event_type")


@query(f"SELECT event_id, round(x, 6) + 0.0 AS x FROM (SELECT event_id, {NANS} AS x FROM events) WHERE x >= 400 AND NOT isnan(x)")
def mask_indices(spark, d):
    return rounded(frame.filtered(_with_nans(spark, d), frame.greater_equal("x", 400)).select("event_id", "x"))


@query("SELECT event_id, round(CASE WHEN value > 100 THEN value ELSE -value END, 6) + 0.0 AS chosen FROM events")
def choose_where(spark, d):
    return rounded(T(spark, d, "events").select("event_id", frame.choose(F.col("value") > 100, F.col("value"), -F.col("value")).alias("chosen")))


@query(f"SELECT event_id, row_number() OVER (ORDER BY isnan(x), x DESC, event_id) AS place FROM (SELECT event_id, {NANS} AS x FROM events)")
def sorted_nan_last(spark, d):
    df = _with_nans(spark, d)
    down = F.when(F.isnan("x"), F.lit(float("inf"))).otherwise(-F.col("x"))  # NaN last in descending order
    ranks = sorted_indices(df.select("event_id", down.alias("k")), "k", "event_id", "at").select((F.col("rank") + 1).alias("place"), "at")
    return with_position(df.select("event_id"), "event_id", "at").join(ranks, "at").select("event_id", "place")


@query("SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderkey, round(o_totalprice, 2) + 0.0 AS o_totalprice FROM orders QUALIFY rank <= 25")
def topk_labels(spark, d):
    return rounded(frame.top_indices(T(spark, d, "orders"), "o_totalprice", "o_orderkey", 25), 2)


@query("SELECT * FROM (SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS rank, row_number() OVER (ORDER BY c_custkey) - 1 AS index FROM customer)")
def argsort(spark, d):
    return sorted_indices(T(spark, d, "customer"), "c_acctbal", "c_custkey")


@query("SELECT p_partkey, p_brand, row_number() OVER (ORDER BY p_brand, p_partkey) - 1 AS position FROM part")
def positions_by_brand(spark, d):
    """Places in the order of a text and a number."""
    return frame.ranked(T(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_returnflag DESC, l_quantity, l_orderkey, l_linenumber) - 1 AS position FROM lineitem")
def positions_of_hot_values(spark, d):
    """Places in an order whose first column has three values for all rows."""
    lines = T(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_orderkey", "l_linenumber")
    return frame.ranked(lines, F.desc("l_returnflag"), "l_quantity", "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "position")


@query("SELECT event_id, CAST(trunc(value) AS INTEGER) AS label FROM events")
def labels_column(spark, d):
    return T(spark, d, "events").select("event_id", frame.labels("value").alias("label"))


@query("SELECT l_orderkey, l_linenumber, CAST(i AS INTEGER) AS position, round(CASE i WHEN 0 THEN l_quantity WHEN 1 THEN l_discount ELSE l_tax END, 6) + 0.0 AS x FROM lineitem, (SELECT unnest([0, 1, 2]) AS i)")
def to_matrix(spark, d):
    df = frame.to_matrix(T(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return rounded(df.select("l_orderkey", "l_linenumber", F.posexplode("features").alias("position", "x")))
