"""What models share: equations as text, grouping by predicted label, and JSON."""

from __future__ import annotations

import json
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions.polynomials import format_number

_SUBSCRIPT = str.maketrans("0123456789", "₀₁₂₃₄₅₆₇₈₉")


def _tuples(value):
    return tuple(map(_tuples, value)) if isinstance(value, list) else value


class Jsonable:
    """Parameters to and from JSON text or files."""

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str):
        return cls(**{k: _tuples(v) for k, v in json.loads(text).items()})

    def save(self, path: str | Path, spark: SparkSession | None = None) -> None:
        """As a file of the driver's machine, or, with a session, as text in a folder of any store that Spark writes."""
        if spark is None:
            Path(path).write_text(self.to_json())
        else:
            spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.text(str(path))

    @classmethod
    def load(cls, path: str | Path, spark: SparkSession | None = None):
        return cls.from_json(Path(path).read_text() if spark is None else "\n".join(r["value"] for r in spark.read.text(str(path)).collect()))


class Regressor(Jsonable):
    def predict(self, df: DataFrame, features: str, name: str = "predicted") -> DataFrame:
        raise NotImplementedError

    def equation(self) -> str:
        """y = b + w₁x₁ ... of models with ``coefficients``, the intercept first; zero weights are left out."""
        b, *weights = self.coefficients
        out = format_number(b)
        for k, w in enumerate(weights, 1):
            if w:
                out += f" {'-' if w < 0 else '+'} {format_number(abs(w))}x{str(k).translate(_SUBSCRIPT)}"
        return f"y = {out}"


class Classifier(Jsonable):
    def predict(self, df: DataFrame, features: str, name: str = "predicted") -> DataFrame:
        raise NotImplementedError

    def classify(self, df: DataFrame, features: str) -> DataFrame:
        """(label, count) of the predicted classes in order of label."""
        return self.predict(df, features, "_label").groupBy(F.col("_label").alias("label")).agg(F.count("*").alias("count")).orderBy("label")
