"""A scaler and a model that was fitted on scaled features; both are applied to new rows alike."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from statloom.models.bayes import GaussianNaiveBayes
from statloom.models.kmeans import KMeans
from statloom.models.linear import GradientDescent, LinearRegression, LogisticRegression, Ridge
from statloom.models.neighbours import KNearestNeighbours
from statloom.models.scaling import StandardScaler


@dataclass(frozen=True)
class Pipeline:
    scaler: StandardScaler
    model: Any

    @classmethod
    def _fit(cls, kind: type, df: DataFrame, features: str, *columns: str, **options) -> Pipeline:
        scaler = StandardScaler.fit(df, features)
        scaled = scaler.transform(df, features, "_scaled")
        return cls(scaler, kind.fit(scaled, "_scaled", *columns, **options))

    @classmethod
    def naive_bayes(cls, df: DataFrame, features: str, label: str) -> Pipeline:
        return cls._fit(GaussianNaiveBayes, df, features, label)

    @classmethod
    def logistic(cls, df: DataFrame, features: str, label: str, **options) -> Pipeline:
        return cls._fit(LogisticRegression, df, features, label, **options)

    @classmethod
    def linear(cls, df: DataFrame, features: str, target: str) -> Pipeline:
        return cls._fit(LinearRegression, df, features, target)

    @classmethod
    def gradient_descent(cls, df: DataFrame, features: str, target: str, **options) -> Pipeline:
        return cls._fit(GradientDescent, df, features, target, **options)

    @classmethod
    def k_means(cls, df: DataFrame, features: str, k: int, order: str, **options) -> Pipeline:
        return cls._fit(KMeans, df, features, k, order=order, **options)

    @classmethod
    def nearest_neighbours(cls, df: DataFrame, id: str, features: str, label: str, **options) -> Pipeline:
        scaler = StandardScaler.fit(df, features)
        return cls(scaler, KNearestNeighbours.fit(scaler.transform(df, features, "_scaled"), id, "_scaled", label, **options))

    def predict(self, df: DataFrame, features: str, name: str = "predicted", id: str | None = None) -> DataFrame:
        """df with the prediction; nearest neighbours give (query, predicted) and need the rows' id."""
        scaled = self.scaler.transform(df, features, "_scaled")
        if isinstance(self.model, KNearestNeighbours):
            if id is None:
                raise ValueError("nearest neighbours need the rows' id")
            return self.model.predict(scaled, id, "_scaled")
        return self.model.predict(scaled, "_scaled", name).drop("_scaled")

    def save(self, path: str, spark: SparkSession) -> None:
        """Scaler and model as rows of JSON under path; nearest neighbours' training rows as Parquet."""
        rows = [("scaler", type(self.scaler).__name__, self.scaler.to_json())]
        if isinstance(self.model, KNearestNeighbours):
            self.model.save(f"{path}/neighbours")
        else:
            rows.append(("model", type(self.model).__name__, self.model.to_json()))
        spark.createDataFrame(rows, "part string, kind string, parameters string").coalesce(1).write.parquet(f"{path}/parts")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> Pipeline:
        parts = {r["part"]: (r["kind"], r["parameters"]) for r in spark.read.parquet(f"{path}/parts").collect()}
        kinds = {k.__name__: k for k in (StandardScaler, GaussianNaiveBayes, KMeans, GradientDescent, LinearRegression, LogisticRegression, Ridge)}
        scaler, model = (kinds[parts[p][0]].from_json(parts[p][1]) if p in parts else None for p in ("scaler", "model"))
        return cls(scaler, KNearestNeighbours.load(spark, f"{path}/neighbours") if model is None else model)

    def __str__(self) -> str:
        return f"Pipeline: {self.scaler}, {self.model}"
