"""Streams against their batch forms, files, rendering, and the package without its pipeline operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom import render
from statloom.models.linear import LinearRegression
from statloom.operators import aggregates, groups
from statloom.operators import series as batch
from statloom.sources import files, generators
from statloom.streaming import series

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture
def events(spark, tmp_path):
    """Events as a folder of three files, one micro-batch each, and as a table."""
    rows = [(k % 3, k, float((k * 7) % 11), 1_700_000_000 + k * 20) for k in range(90)]
    df = spark.createDataFrame(rows, "key long, at long, x double, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    for part in range(3):
        df.where(F.floor(F.col("at") / 30) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    return stream, df


def run(stream, tmp_path, mode="append"):
    name = f"out_{abs(hash(str(tmp_path)))}"
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return stream.sparkSession.table(name)


def test_windows(events, tmp_path):
    stream, df = events
    made = run(series.windowed(stream, "ts", "x", "5 minutes", "mean", by=("key",)), tmp_path, "complete")
    want = df.groupBy(F.window("ts", "5 minutes").alias("w"), "key").agg(F.avg("x").alias("value"))
    assert {(r["start"], r["key"], round(r["value"], 9)) for r in made.collect()} == {(r["w"]["start"], r["key"], round(r["value"], 9)) for r in want.collect()}
    with pytest.raises(ValueError):
        series.windowed(stream, "ts", "x", "5 minutes", "median")


def test_sessions(events, tmp_path):
    stream, _ = events
    made = run(series.sessions(stream, "ts", "2 minutes", ("key",), "1 second"), tmp_path)
    assert made.count() <= 3


def test_smoothing(events, tmp_path):
    stream, df = events
    made = {(r["key"], r["at"]): r["smoothed"] for r in run(series.exponential_mean(stream, "key", "at", "x", 0.3), tmp_path).collect()}
    want = {(r["key"], r["at"]): r["smoothed"] for r in batch.exponential_mean(df, "x", "at", 0.3, by=("key",)).collect()}
    assert made.keys() == want.keys() and all(abs(made[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("form", files.FORMATS)
def test_files(spark, tmp_path, form):
    df = spark.createDataFrame([(1, 2.5, "a"), (2, 3.5, "b")], "k int, x double, s string")
    files.write(df, str(tmp_path / form), form)
    assert sorted(map(tuple, files.read(spark, str(tmp_path / form), form, "k int, x double, s string").collect())) == [(1, 2.5, "a"), (2, 3.5, "b")]
    with pytest.raises(ValueError):
        files.read(spark, "x", "xml")


def test_numeric(spark):
    df = spark.createDataFrame([("b", None), ("a", 2.0), (None, 1.0)], "s string, x double")
    got = [tuple(r) for r in files.numeric(df).collect()]
    assert got[0][0] == 1 and got[1] == (0, 2) and np.isnan(got[0][1]) and np.isnan(got[2][0])
    with pytest.raises(ValueError):
        files.numeric(df, 1)


def test_generators(spark):
    assert generators.uniform(spark, 50, 2, 3, 1).where("x < 2 or x >= 3").count() == 0
    assert generators.integers(spark, 200, 1, 4, 1).select("x").distinct().count() == 3
    assert generators.binomial(spark, 30, 5, 1.0, 1).where("x = 5").count() == 30 and generators.binomial(spark, 30, 0, 0.5, 1).where("x = 0").count() == 30
    one, two = generators.Xorshift(7), generators.Xorshift(7)
    assert [one.next() for _ in range(5)] == [two.next() for _ in range(5)] and 0 <= one.unit() < 1
    assert generators.Xorshift(0).state == 1


def test_rendering(spark):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, x double")
    assert render.markdown(df).splitlines() == ["| k | x |", "| --- | --- |", "| a | 1.5 |", "| b |  |"]
    assert render.csv(df) == ["k,x", "a,1.5", "b,"] and len(render.text(df).splitlines()) == 3
    table = groups.contingency(spark.createDataFrame([("r", "c"), ("r", "d")], "a string, b string"), "a", "b")
    assert render.contingency_csv(table) == "1,1" and "| Total | 1 | 1 | 2 |" in render.contingency_markdown(table)
    assert render.vector([1, 2.5], inline=True) == "[1, 2.5]" and len(render.matrix([[1, 2], [3, 4]]).splitlines()) == 2
    points = spark.createDataFrame([(float(k), 2.0 * k + (k % 2)) for k in range(8)], "x double, y double")
    summary = LinearRegression.summary(points, ["x"], "y")
    assert len(render.regression_csv(summary)) == 3 and render.regression_markdown(summary).count("\n") == 3
    assert "count: 8" in render.info(points, "x", "x") and "column" in render.summary_markdown(aggregates.frame_summary(points, ["x", "y"]))


def test_without_pipeline_operators(tmp_path):
    """The rest imports and lists its queries when the subpackage and the pipeline are deleted."""
    shutil.copytree(ROOT / "statloom", tmp_path / "statloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not [n for n in q if n.startswith('op')]"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
