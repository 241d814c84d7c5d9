"""Gaussian naive Bayes from one grouping of the features."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.vectors import as_doubles, let, literal, softmax
from statloom.models.base import Classifier
from statloom.models.scaling import vector_stats

#: The least variance of a feature in a class.
LEAST_VARIANCE = 1e-9


@dataclass(frozen=True)
class GaussianNaiveBayes(Classifier):
    """For each class, in order of label: prior, and mean and population variance of each feature."""

    labels: tuple[int, ...]
    priors: tuple[float, ...]
    means: tuple[tuple[float, ...], ...]
    variances: tuple[tuple[float, ...], ...]

    @classmethod
    def fit(cls, df: DataFrame, features: str, label: str) -> GaussianNaiveBayes:
        stats = class_stats(df, features, label).orderBy("label", "position").collect()
        if not stats:
            raise ValueError("there are no rows to fit")
        by: dict[int, list] = {}
        for r in stats:
            by.setdefault(r["label"], []).append(r)
        whole = sum(rows[0]["n"] for rows in by.values())
        pick = lambda name: tuple(tuple(r[name] for r in rows) for rows in by.values())
        return cls(tuple(by), tuple(rows[0]["n"] / whole for rows in by.values()), pick("mean"), pick("variance"))

    def log_joint(self, features: str) -> Column:
        """Vector of log(prior) + log density, one for each class; a feature whose density is undefined is left out."""
        x = as_doubles(features)
        classes = []
        for prior, means, variances in zip(self.priors, self.means, self.variances):
            parts = F.arrays_zip(literal(means).alias("m"), literal(variances).alias("v"))
            density = F.zip_with(x, parts, lambda e, p: -0.5 * (F.log(F.lit(2 * math.pi) * p["v"]) + (e - p["m"]) * (e - p["m"]) / p["v"]))
            classes.append(F.aggregate(density, F.lit(math.log(prior)), lambda s, d: s + F.when(d.isNull() | F.isnan(d), F.lit(0.0)).otherwise(d)))
        return F.array(*classes)

    def probabilities(self, features: str) -> Column:
        return softmax(self.log_joint(features))

    def column(self, features: str) -> Column:
        best = let(self.log_joint(features), lambda joint: F.array_position(joint, F.array_max(joint)).cast("int") - 1)
        return F.get(F.array(*map(F.lit, self.labels)), best)

    def predict(self, df: DataFrame, features: str, name: str = "predicted") -> DataFrame:
        """The likeliest class, the least label of equals."""
        return df.withColumn(name, self.column(features))

    def __str__(self) -> str:
        return f"GaussianNaiveBayes: {len(self.labels)} classes, {len(self.means[0])} features"


def class_stats(df: DataFrame, features: str, label: str) -> DataFrame:
    """(label, position, n, mean, variance)."""
    rows = df.where(F.col(label).isNotNull()).withColumn("label", F.col(label).cast("int"))
    return vector_stats(rows, features, F.count("*").alias("n"), F.avg("x").alias("mean"), F.greatest(F.var_pop("x"), F.lit(LEAST_VARIANCE)).alias("variance"), by=("label",))
