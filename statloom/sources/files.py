"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.session import ship

FORMATS = ("parquet", "orc", "json", "csv")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """folder/name.parquet."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, path: str, form: str = "parquet", schema: str | None = None) -> DataFrame:
    """A file or folder; CSV files have a header line, and types are inferred only without a schema."""
    if form not in FORMATS:
        raise ValueError(f"form must be one of {', '.join(FORMATS)}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("header", True).option("inferSchema", schema is None).csv(path) if form == "csv" else reader.format(form).load(path)


def write(df: DataFrame, path: str, form: str = "parquet", by: tuple[str, ...] = ()) -> None:
    if form not in FORMATS:
        raise ValueError(f"form must be one of {', '.join(FORMATS)}")
    writer = df.write.format(form)
    if form == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*by) if by else writer).save(path)


def numeric(df: DataFrame, most_classes: int = 10_000) -> DataFrame:
    """All columns as doubles: strings as classes numbered in alphabetical order, times as seconds, missing values as NaN."""
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f.name)
        if kind == "string":
            classes = df.select(f.name).where(c.isNotNull()).distinct().limit(most_classes + 1)
            names = sorted(r[0] for r in classes.collect())
            if len(names) > most_classes:
                raise ValueError(f"{f.name} has more than {most_classes} different strings")
            c = (F.array_position(F.array(*map(F.lit, names)), c) - 1).cast("double") if names else F.lit(None).cast("double")
        elif kind in ("timestamp", "timestamp_ntz", "date"):
            c = F.unix_micros(c.cast("timestamp")) / 1e6
        df = df.withColumn(f.name, F.coalesce(c.cast("double"), F.lit(float("nan"))))
    return df
