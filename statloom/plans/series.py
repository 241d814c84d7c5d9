"""Queries of series, histograms, correlation, signals and streams' batch counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.core import with_position
from statloom.operators import correlation, groups, histograms, series, signal
from statloom.plans.registry import query, rounded
from statloom.sources import generators
from statloom.sources.files import table as T

BY = ("event_type",)


def _events(spark, d):
    return T(spark, d, "events").select("event_id", "event_type", "value")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS 2 PRECEDING), 6) + 0.0 AS rolling FROM events")
def rolling_mean_3(spark, d):
    return rounded(series.rolling_mean(_events(spark, d), "value", "event_id", 3, BY).select("event_id", "rolling"))


@query("SELECT event_id, round(avg(value) OVER (ORDER BY event_id ROWS 49 PRECEDING), 6) + 0.0 AS rolling FROM events")
def rolling_mean_50_whole(spark, d):
    return rounded(series.rolling_mean(_events(spark, d), "value", "event_id", 50).select("event_id", "rolling"))


@query("SELECT s_suppkey, round(avg(s_acctbal) OVER (), 6) + 0.0 AS rolling FROM supplier")
def rolling_window_larger_than_n(spark, d):
    """The window is larger than the table, however many suppliers there are."""
    suppliers = T(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return rounded(series.rolling_mean(suppliers, "s_acctbal", "s_suppkey", max(5000, suppliers.count() + 1)).select("s_suppkey", "rolling"))


@query("SELECT event_id, round(value - lag(value, 2) OVER w, 6) + 0.0 AS diff FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id) QUALIFY lag(event_id, 2) OVER w IS NOT NULL")
def diff_lag2(spark, d):
    return rounded(series.diff(_events(spark, d), "value", "event_id", 2, BY).select("event_id", "diff"))


@query("SELECT event_id, round(value - lag(value, 7) OVER w, 6) + 0.0 AS diff FROM events WINDOW w AS (ORDER BY event_id) QUALIFY lag(event_id, 7) OVER w IS NOT NULL")
def diff_lag7_whole(spark, d):
    return rounded(series.diff(_events(spark, d), "value", "event_id", 7).select("event_id", "diff"))


@query("""
WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 50 = 0 THEN 0 ELSE value END AS x FROM events)
SELECT event_id, round(CASE WHEN lag(x) OVER w = 0 THEN 0 ELSE (x - lag(x) OVER w) / lag(x) OVER w * 100 END, 4) + 0.0 AS change FROM e WINDOW w AS (PARTITION BY event_type ORDER BY event_id) QUALIFY lag(event_id) OVER w IS NOT NULL
""")
def pct_change(spark, d):
    df = _events(spark, d).withColumn("x", F.when(F.col("event_id") % 50 == 0, 0.0).otherwise(F.col("value")))
    return rounded(series.percent_change(df, "x", "event_id", 1, BY).select("event_id", "change"), 4)


@query("SELECT event_id, round((value - lag(value) OVER w) / 0.5, 6) + 0.0 AS derivative FROM events WINDOW w AS (ORDER BY event_id) QUALIFY lag(event_id) OVER w IS NOT NULL")
def derivative(spark, d):
    return rounded(series.derivative(_events(spark, d), "value", "event_id", 0.5).select("event_id", "derivative"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY event_id), 4) + 0.0 AS cumulative FROM events")
def cumulative_sum(spark, d):
    return rounded(series.cumulative_sum(_events(spark, d), "value", "event_id", BY).select("event_id", "cumulative"), 4)


@query("SELECT event_id, round(sum(value) OVER (ORDER BY event_id), 3) + 0.0 AS cumulative FROM events")
def cumulative_sum_whole(spark, d):
    return rounded(series.cumulative_sum(_events(spark, d), "value", "event_id").select("event_id", "cumulative"), 3)


@query("SELECT event_id, round(product(1 + value / 1e6) OVER (PARTITION BY event_type ORDER BY event_id), 6) + 0.0 AS cumulative FROM events")
def cumulative_product(spark, d):
    df = _events(spark, d).withColumn("f", 1 + F.col("value") / 1e6)
    return rounded(series.cumulative_product(df, "f", "event_id", BY).select("event_id", "cumulative"))


@query("SELECT event_id, round(product(1 + value / 1e7) OVER (ORDER BY event_id), 6) + 0.0 AS cumulative FROM events")
def cumulative_product_whole(spark, d):
    df = _events(spark, d).withColumn("f", 1 + F.col("value") / 1e7)
    return rounded(series.cumulative_product(df, "f", "event_id").select("event_id", "cumulative"))


EMA = """
WITH RECURSIVE o AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS i FROM events),
s AS (SELECT i, event_id, value AS s FROM o WHERE i = 1 UNION ALL SELECT o.i, o.event_id, {a} * o.value + (1 - {a}) * s.s FROM s JOIN o ON o.i = s.i + 1)
SELECT event_id, round(s, 6) + 0.0 AS smoothed FROM s
"""


@query(EMA.format(a=0.2))
def ema_alpha(spark, d):
    return rounded(series.exponential_mean(_events(spark, d), "value", "event_id", alpha=0.2).select("event_id", "smoothed"))


@query(EMA.format(a="(2.0 / 20)"))
def ema_span(spark, d):
    return rounded(series.exponential_mean(_events(spark, d), "value", "event_id", span=19).select("event_id", "smoothed"))


@query("SELECT p_partkey, round(-1 + (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) * 2, 6) + 0.0 AS scaled FROM part")
def scaled_range(spark, d):
    return rounded(series.scaled(T(spark, d, "part"), "p_retailprice", -1, 1).select("p_partkey", "scaled"))


@query("SELECT s_suppkey, round(s_acctbal * 100 / sum(s_acctbal) OVER (), 6) + 0.0 AS percent FROM supplier")
def share_percent(spark, d):
    return rounded(series.as_percentages(T(spark, d, "supplier"), "s_acctbal").select("s_suppkey", "percent"))


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) + 0.0 AS standardized FROM customer")
def standardized(spark, d):
    return rounded(series.standardized(T(spark, d, "customer"), "c_acctbal").select("c_custkey", "standardized"))


def _downsample(method: str, sql: str) -> None:
    @query(f"SELECT CAST(i // 50 AS BIGINT) AS chunk, round({sql}, 4) + 0.0 AS value FROM (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) GROUP BY 1", name=f"downsample_50_{method}")
    def down(spark, d):
        return rounded(groups.downsample(with_position(_events(spark, d), "event_id"), "position", "value", 50, method), 4)


_downsample("mean", "avg(value)")
_downsample("percentage", "sum(value)")


@query("SELECT l_linenumber AS series, l_suppkey AS position, round(sum(sum(l_quantity)) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber), 4) + 0.0 AS stacked FROM lineitem GROUP BY 1, 2")
def stacked_cumulative(spark, d):
    df = T(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("series"), F.col("l_suppkey").alias("position")).agg(F.sum("l_quantity").alias("x"))
    return rounded(series.stacked_cumulative(df, "series", "position", "x").drop("x"), 4)


@query("SELECT l_linenumber AS series, l_suppkey AS position, round(sum(l_quantity) * 100 / sum(sum(l_quantity)) OVER (PARTITION BY l_suppkey), 6) + 0.0 AS percent FROM lineitem GROUP BY 1, 2")
def stacked_percentage(spark, d):
    df = T(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("series"), F.col("l_suppkey").alias("position")).agg(F.sum("l_quantity").alias("x"))
    return rounded(series.stacked_percentage(df, "series", "position", "x").drop("x"))


@query("SELECT event_type, round(sum(a), 4) + 0.0 AS integral FROM (SELECT event_type, (value + lag(value) OVER (PARTITION BY event_type ORDER BY event_id)) * 0.25 AS a FROM events) GROUP BY event_type")
def trapezoid_total(spark, d):
    return rounded(series.trapezoidal_integral(_events(spark, d), "value", "event_id", 0.5, BY), 4)


@query("SELECT event_id, round(coalesce(sum(a) OVER (ORDER BY event_id), 0), 4) + 0.0 AS integral FROM (SELECT event_id, (value + lag(value) OVER (ORDER BY event_id)) * 0.25 AS a FROM events)")
def trapezoid_running(spark, d):
    return rounded(series.cumulative_trapezoidal(_events(spark, d), "value", "event_id", 0.5).select("event_id", "integral"), 4)


# Histograms and correlation

HISTOGRAM = """
WITH s AS (SELECT min({x}) AS low, max({x}) AS high, {bins} AS bins FROM {t}),
w AS (SELECT low, (high - low) / bins AS width, CAST(bins AS BIGINT) AS bins FROM s),
c AS (SELECT CAST(least(floor(({x} - low) / width), bins - 1) AS BIGINT) AS bin, count(*) AS count FROM {t}, w GROUP BY 1)
SELECT b.bin, round(low + width * (b.bin + 0.5), 4) + 0.0 AS midpoint, coalesce(c.count, 0) AS count FROM w, (SELECT unnest(range(0, (SELECT bins FROM w))) AS bin) b LEFT JOIN c ON c.bin = b.bin
"""


@query(HISTOGRAM.format(x="o_totalprice", t="orders", bins="10"))
def histogram_10(spark, d):
    return rounded(histograms.histogram(T(spark, d, "orders"), "o_totalprice", 10), 4)


@query(HISTOGRAM.format(x="c_acctbal", t="customer", bins="ceil(sqrt(count(*)))"))
def histogram_square_root(spark, d):
    return rounded(histograms.histogram(T(spark, d, "customer"), "c_acctbal", "square_root"), 4)


@query(HISTOGRAM.format(x="value", t="events", bins="ceil(log2(count(*)) + 1)"))
def histogram_sturges(spark, d):
    return rounded(histograms.histogram(T(spark, d, "events"), "value", "sturges"), 4)


@query(HISTOGRAM.format(x="value", t="events", bins="ceil((max(value) - min(value)) / (2 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / cbrt(count(*))))"))
def histogram_fd(spark, d):
    return rounded(histograms.histogram(T(spark, d, "events"), "value", "freedman_diaconis"), 4)


_PAIRS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, " + ("CAST(1 AS DOUBLE)" if a == b else f"round(corr({a}, {b}), 6) + 0.0") + " AS value" + ("" if a == b else " FROM lineitem") for a in _PAIRS for b in _PAIRS))
def correlation_matrix_long(spark, d):
    return rounded(correlation.correlation_pairs(T(spark, d, "lineitem"), list(_PAIRS)))


@query("SELECT * FROM (VALUES ('p_size', 'p_size', 'one'), ('p_size', 'constant', 'undefined'), ('constant', 'p_size', 'undefined'), ('constant', 'constant', 'one')) AS v(x, y, value)")
def correlation_constant_column(spark, d):
    df = T(spark, d, "part").select("p_size", F.lit(7.0).alias("constant"))
    return correlation.correlation_pairs(df, ["p_size", "constant"]).select("x", "y", F.when(F.isnan("value"), "undefined").when(F.col("value") == 1, "one").otherwise("other").alias("value"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) + 0.0 AS correlation FROM lineitem")
def correlation_two(spark, d):
    return rounded(correlation.correlation(T(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@query("SELECT v.x, v.y, CASE WHEN v.x = v.y THEN 1.0 ELSE (SELECT round(corr(l_discount, l_tax), 6) + 0.0 FROM lineitem) END AS value FROM (VALUES ('Discount', 'Discount'), ('Discount', 'Tax'), ('Tax', 'Discount'), ('Tax', 'Tax')) AS v(x, y)")
def heatmap(spark, d):
    return rounded(correlation.heatmap(T(spark, d, "lineitem"), ["l_discount", "l_tax"], ["Discount", "Tax"]))


# Signals: one series for each user, and all events as one


DFT = """
WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, count(*) OVER (PARTITION BY user_id) AS m FROM events),
s AS (SELECT user_id, any_value(m) AS m, CAST(pow(2, ceil(log2(any_value(m)))) AS BIGINT) AS size FROM e GROUP BY user_id),
k AS (SELECT user_id, m, size, unnest(range(0, size)) AS k FROM s),
f AS (SELECT user_id, k.m, size, k, sum(value * cos(2 * pi() * k * n / size)) AS re, -sum(value * sin(2 * pi() * k * n / size)) AS im FROM k JOIN e USING (user_id) GROUP BY user_id, k.m, size, k)
"""


def _users(spark, d):
    return T(spark, d, "events").select("user_id", "event_id", "value")


@query(DFT + "SELECT user_id, round(k * 100.0 / size, 6) + 0.0 AS frequency, round(sqrt(re * re + im * im), 4) + 0.0 AS magnitude FROM f WHERE k < size // 2")
def fourier_spectrum(spark, d):
    return rounded(signal.fourier_spectrum(_users(spark, d), "value", "event_id", 100.0, by=("user_id",)), 4, frequency=6)


PSD = DFT + ", p AS (SELECT user_id, size, k AS bin, k * 100.0 / size AS frequency, (re * re + im * im) / (100.0 * size) * CASE WHEN k = 0 OR k = size // 2 THEN 1 ELSE 2 END AS density FROM f WHERE k <= size // 2 AND m > 1)"


@query(PSD + "SELECT user_id, bin, round(frequency, 6) + 0.0 AS frequency, round(density, 4) + 0.0 AS density FROM p")
def psd_one_sided(spark, d):
    return rounded(signal.density(_users(spark, d), "value", "event_id", 100.0, by=("user_id",)), 4, frequency=6)


@query(PSD + "SELECT user_id, round(coalesce(sum(density) FILTER (frequency BETWEEN 5 AND 20), 0) * 100.0 / any_value(size), 4) + 0.0 AS energy, round(max_by(frequency, density) FILTER (bin > 0), 6) + 0.0 AS dominant FROM p GROUP BY user_id")
def band_energy(spark, d):
    p = signal.density(_users(spark, d), "value", "event_id", 100.0, by=("user_id",))
    return rounded(signal.band_energy(p, 5, 20, ("user_id",)).join(signal.dominant(p, ("user_id",)), "user_id"), 4, dominant=6)


def _all(spark, d):
    return with_position(_events(spark, d), "event_id").select("position", "value")


@query("SELECT n AS position, round(value * 0.5 * (1 - cos(2 * pi() * n / (m - 1))), 6) + 0.0 AS windowed FROM (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS n, count(*) OVER () AS m FROM events)")
def hann_window(spark, d):
    return rounded(signal.hann_windowed(_all(spark, d), "value", "position").select("position", "windowed"))


@query("""WITH e AS (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS position FROM events)
SELECT p AS position, round(coalesce(value, 0), 6) + 0.0 AS value FROM (SELECT unnest(range(0, (SELECT CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) FROM events))) AS p) LEFT JOIN e ON p = position""")
def padded_power_of_two(spark, d):
    return rounded(signal.padded_rows(_all(spark, d), "value", "position"))


WHOLE = """WITH s AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS p, value AS x FROM events), n AS (SELECT CAST(2 ** ceil(log2(count(*))) AS BIGINT) AS n FROM s),
b AS (SELECT k, n, cos(2 * pi() * k / n) AS c, sin(2 * pi() * k / n) AS s FROM n, (SELECT unnest(range(0, (SELECT n FROM n))) AS k)),
f AS (SELECT b.k, sum(x * t.c) AS re, CASE WHEN b.k = 0 OR 2 * b.k = any_value(b.n) THEN 0.0 ELSE -sum(x * t.s) END AS im, any_value(b.n) AS n FROM s, b, b t WHERE t.k = b.k * s.p % b.n GROUP BY b.k)
"""


@query(WHOLE + "SELECT k AS bin, round(sqrt(re * re + im * im), 3) + 0.0 AS magnitude, round(atan2(im, re), 3) + 0.0 AS phase FROM f")
def fourier_whole(spark, d):
    """Magnitude and phase of all events as one padded series."""
    return rounded(signal.fourier(signal.padded_rows(_all(spark, d), "value", "position"), "value", "position"), 3)


@query(WHOLE + "SELECT k AS position, round(re / n, 5) + 0.0 AS value FROM f")
def fourier_inverse(spark, d):
    return rounded(signal.fourier_inverse(signal.padded_rows(_all(spark, d), "value", "position"), "value", "position"), 5)


@query("""WITH e AS (SELECT event_id, value > 2 AS many, value AS x FROM events)
SELECT event_id, many, round(sum(x) OVER (w ROWS UNBOUNDED PRECEDING), 3) + 0.0 AS cumulative, round(avg(x) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) + 0.0 AS rolling FROM e WINDOW w AS (PARTITION BY many ORDER BY event_id)""")
def series_of_a_hot_group(spark, d):
    """Running sums and rolling means of two groups, one of which has nearly all events: beyond 65,536 rows it goes block by block."""
    events = T(spark, d, "events").select("event_id", (F.col("value") > 2).alias("many"), F.col("value").alias("x"))
    summed = series.cumulative_sum(events, "x", "event_id", ("many",))
    return rounded(series.rolling_mean(summed, "x", "event_id", 30, ("many",)).drop("x"), 6, cumulative=3)


@query("SELECT p AS position, round(1.5 + 2 * sin(2 * pi() * 5 * p / 100), 6) + 0.0 AS wave, round(value * (1.5 + 2 * sin(2 * pi() * 5 * p / 100)), 5) + 0.0 AS modulated FROM (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events)")
def sine_wave(spark, d):
    """All events modulated by a wave that is as long as they are."""
    events = _all(spark, d)
    wave = generators.sine_wave(spark, 5, 100, events.count(), 2.0, 1.5)
    made = events.join(wave, "position").select("position", F.col("x").alias("wave"), (F.col("value") * F.col("x")).alias("modulated"))
    return rounded(made, 6, modulated=5)


@query("""SELECT kind, count(*) AS n, CAST(count(*) AS BIGINT) AS in_range, true AS mean_fits, true AS spread_fits
FROM part, (SELECT unnest(['uniform', 'normal', 'exponential', 'binomial', 'integers']) AS kind) GROUP BY kind""")
def random_series(spark, d):
    """For each generator, noise for every part: how many numbers are in its range, and whether mean and spread are what they should be (within 8 standard errors)."""
    parts = with_position(T(spark, d, "part").select("p_partkey"), "p_partkey")
    n = parts.count()
    wanted = {  # the generator's series, range, mean and variance
        "uniform": (generators.uniform(spark, n, -1, 1, 1), -1, 1, 0, 1 / 3),
        "normal": (generators.normal(spark, n, 5, 2, 2), -1e9, 1e9, 5, 4),
        "exponential": (generators.exponential(spark, n, 2, 3), 0, 1e9, 0.5, 0.25),
        "binomial": (generators.binomial(spark, n, 10, 0.3, 4), 0, 10, 3, 2.1),
        "integers": (generators.integers(spark, n, 3, 9, 5), 3, 8, 5.5, 35 / 12),
    }
    made = None
    for name, (df, low, high, mean, variance) in wanted.items():
        noise = parts.join(df, "position").select(F.col("x").cast("double").alias("x"))
        found = noise.agg(
            F.count("*").alias("n"),
            F.count_if(F.col("x").between(low, high)).alias("in_range"),
            (F.abs(F.avg("x") - mean) < 8 * F.sqrt(F.lit(float(variance)) / F.count("*"))).alias("mean_fits"),
            (F.abs(F.var_pop("x") / variance - 1) < 8 * F.sqrt(9.0 / F.count("*"))).alias("spread_fits"),
        ).select(F.lit(name).alias("kind"), "*")
        made = found if made is None else made.union(found)
    return made
