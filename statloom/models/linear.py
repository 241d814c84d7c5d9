"""Linear models: least squares with inference, gradient descent, ridge, and logistic regression.

Least squares, gradient descent and ridge need the sums of products of features and targets alone, so one aggregate over the rows
is all they read: every later step works on a matrix of the number of features. Logistic regression reads the rows once a step.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.distributions import incomplete_beta, t_quantile
from statloom.functions.linalg import Singular, inverse
from statloom.functions.vectors import as_doubles, literal
from statloom.models.base import Classifier, Regressor


class Diverged(ArithmeticError):
    """The loss rose or stopped being finite."""


@dataclass(frozen=True)
class Moments:
    """X'X, X'y, y'y and sum(y) of n rows; the first column of X is 1."""

    n: int
    xx: np.ndarray
    xy: np.ndarray
    yy: float
    y: float

    @classmethod
    def of(cls, df: DataFrame, features: list[str] | str, target: str) -> Moments:
        if isinstance(features, str):
            size = df.select(F.size(features)).first()
            columns = [F.get(as_doubles(features), F.lit(k)) for k in range(size[0] if size else 0)]
        else:
            columns = [F.col(c).cast("double") for c in features]
        rows = df.select(*(c.alias(f"x{k}") for k, c in enumerate(columns)), F.col(target).cast("double").alias("y")).na.drop()
        x = [F.lit(1.0), *(F.col(f"x{k}") for k in range(len(columns)))]
        p = len(x)
        sums = {f"s{i}_{j}": F.sum(x[i] * x[j]) for i in range(p) for j in range(i, p)} | {f"t{i}": F.sum(x[i] * F.col("y")) for i in range(p)}
        got = rows.agg(F.count("*").alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum("y").alias("sy"), *(c.alias(n) for n, c in sums.items())).first()
        if not got["n"]:
            raise ValueError("there are no rows to fit")
        xx = np.array([[got[f"s{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        return cls(got["n"], xx, np.array([got[f"t{i}"] for i in range(p)]), got["yy"], got["sy"])

    @cached_property
    def best(self) -> tuple[np.ndarray, float]:
        """Weights of the least squares, and what they leave of y'y."""
        w = np.linalg.lstsq(self.xx, self.xy, rcond=None)[0]
        return w, max(0.0, float(self.yy - w @ self.xy))

    def loss(self, w: np.ndarray) -> float:
        """Mean squared error of the weights, as the distance from the best ones: large sums are subtracted once and for all."""
        best, rest = self.best
        return float(((w - best) @ self.xx @ (w - best) + rest) / self.n)

    def gradient(self, w: np.ndarray) -> np.ndarray:
        return 2 / self.n * (self.xx @ (w - self.best[0]))


def linear_column(features: list[str] | str, coefficients) -> Column:
    """b + w1 x1 + ... as a projection."""
    b, *w = map(float, coefficients)
    if isinstance(features, str):
        products = F.zip_with(as_doubles(features), literal(w), lambda x, k: x * k)
        return F.aggregate(products, F.lit(b), lambda s, x: s + x)
    total = F.lit(b)
    for name, k in zip(features, w):
        total = total + F.col(name).cast("double") * F.lit(k)
    return total


@dataclass(frozen=True)
class RegressionSummary:
    """Inference of a least-squares fit, the intercept first."""

    coefficients: tuple[float, ...]
    standard_errors: tuple[float, ...]
    t_values: tuple[float, ...]
    p_values: tuple[float, ...]
    intervals: tuple[tuple[float, float], ...]
    r_squared: float
    adjusted_r_squared: float
    residual_standard_error: float
    degrees_of_freedom: int
    level: float

    def terms(self) -> list[str]:
        return ["intercept", *(f"x{k}" for k in range(1, len(self.coefficients)))]

    def rows(self) -> list[tuple]:
        return [(n, *v, lo, hi) for n, *v, (lo, hi) in zip(self.terms(), self.coefficients, self.standard_errors, self.t_values, self.p_values, self.intervals)]

    def to_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows(), "term string, coefficient double, standard_error double, t double, p double, lower double, upper double")


@dataclass(frozen=True)
class LinearRegression(Regressor):
    """Least squares by normal equations."""

    coefficients: tuple[float, ...]

    @classmethod
    def fit(cls, df: DataFrame, features: list[str] | str, target: str) -> LinearRegression:
        return cls.of(Moments.of(df, features, target))

    @classmethod
    def of(cls, m: Moments) -> LinearRegression:
        return cls(tuple((_scaled_inverse(m.xx) @ m.xy).tolist()))

    def column(self, features: list[str] | str) -> Column:
        return linear_column(features, self.coefficients)

    def predict(self, df: DataFrame, features: list[str] | str, name: str = "predicted") -> DataFrame:
        return df.withColumn(name, self.column(features))

    @classmethod
    def summary(cls, df: DataFrame, features: list[str] | str, target: str, level: float = 0.95) -> RegressionSummary:
        if not 0 < level < 1:
            raise ValueError("level must be between 0 and 1")
        m = Moments.of(df, features, target)
        w = np.array(cls.of(m).coefficients)
        free = m.n - len(w)
        if free < 1:
            raise ValueError("inference needs more rows than coefficients")
        # the residual sum from a second, centred pass: differences of large sums would lose it
        residual = F.col(target).cast("double") - linear_column(features, w)
        centred = F.col(target).cast("double") - m.y / m.n
        got = df.select(residual.alias("r"), centred.alias("c")).na.drop().agg(F.sum(F.col("r") * F.col("r")).alias("r"), F.sum(F.col("c") * F.col("c")).alias("c")).first()
        rest, all_ = got["r"], got["c"]
        error = math.sqrt(rest / free)
        se = error * np.sqrt(np.diag(_scaled_inverse(m.xx)))
        with np.errstate(divide="ignore", invalid="ignore"):
            t = w / se
        p = [incomplete_beta(free / (free + v * v), free / 2, 0.5) if math.isfinite(v) else 0.0 for v in t.tolist()]
        half = t_quantile(1 - (1 - level) / 2, free) * se
        r2 = 1 - rest / all_ if all_ else 0.0
        return RegressionSummary(tuple(w.tolist()), tuple(se.tolist()), tuple(t.tolist()), tuple(p), tuple(zip((w - half).tolist(), (w + half).tolist())), r2, 1 - (1 - r2) * (m.n - 1) / free, error, free, level)

    def __str__(self) -> str:
        return f"LinearRegression: {self.equation()}"


def _scaled_inverse(xx: np.ndarray) -> np.ndarray:
    """The inverse by way of unit diagonals, so that a feature's unit doesn't decide whether the matrix counts as singular."""
    scale = np.sqrt(np.diag(xx))
    if not (scale > 0).all():
        raise Singular
    return inverse(xx / np.outer(scale, scale)) / np.outer(scale, scale)


CONVERGED, EXHAUSTED = "converged", "reached_iteration_limit"
#: Fixed value: the loss below which changes count as they are, not beside the loss.
LEAST_LOSS = 1e-12


def descend(start: np.ndarray, loss, gradient, rate: float, iterations: int, tolerance: float) -> tuple[np.ndarray, list[float], str]:
    """Full-batch descent: weights, the losses from the start on, and how it ended.

    A loss that isn't finite, or that rises by more than the tolerance beside its size, raises Diverged; one that falls by less, or
    not at all, ends the descent; one that rises by less goes on.
    """
    if rate <= 0 or iterations < 1 or tolerance < 0:
        raise ValueError("rate and iterations must be positive, tolerance not negative")
    w, losses = start, [loss(start)]
    if not math.isfinite(losses[0]):
        raise Diverged("the loss is not finite")
    for _ in range(iterations):
        w = w - rate * gradient(w)
        now = loss(w)
        if not math.isfinite(now):
            raise Diverged("the loss is not finite")
        change = (losses[-1] - now) / max(losses[-1], LEAST_LOSS)
        losses.append(now)
        if change < -tolerance:
            raise Diverged("the loss increases")
        if 0 <= change < tolerance:
            return w, losses, CONVERGED
    return w, losses, EXHAUSTED


@dataclass(frozen=True)
class GradientDescent(Regressor):
    """Least squares by full-batch descent from zeros."""

    coefficients: tuple[float, ...]
    losses: tuple[float, ...]
    outcome: str
    rate: float = 0.01

    @classmethod
    def fit(cls, df: DataFrame, features: list[str] | str, target: str, rate: float = 0.01, iterations: int = 1000, tolerance: float = 1e-6) -> GradientDescent:
        m = Moments.of(df, features, target)
        w, losses, outcome = descend(np.zeros(len(m.xy)), m.loss, m.gradient, rate, iterations, tolerance)
        return cls(tuple(w.tolist()), tuple(losses), outcome, rate)

    def column(self, features: list[str] | str) -> Column:
        return linear_column(features, self.coefficients)

    def predict(self, df: DataFrame, features: list[str] | str, name: str = "predicted") -> DataFrame:
        return df.withColumn(name, self.column(features))

    def __str__(self) -> str:
        return f"{type(self).__name__}: {self.equation()}, {self.outcome} after {len(self.losses) - 1} iterations"


@dataclass(frozen=True)
class Ridge(GradientDescent):
    """Mean squared error + strength |w|^2 without the intercept, by descent."""

    strength: float = 0.0

    @classmethod
    def fit(cls, df: DataFrame, features: list[str] | str, target: str, strength: float = 1.0, rate: float = 0.01, iterations: int = 1000, tolerance: float = 1e-6) -> Ridge:
        if strength < 0:
            raise ValueError("strength must not be negative")
        m = Moments.of(df, features, target)
        mask = np.array([0.0, *np.ones(len(m.xy) - 1)])
        loss = lambda w: m.loss(w) + strength * float((mask * w) @ w)
        gradient = lambda w: m.gradient(w) + 2 * strength * mask * w
        w, losses, outcome = descend(np.zeros(len(m.xy)), loss, gradient, rate, iterations, tolerance)
        return cls(tuple(w.tolist()), tuple(losses), outcome, rate, strength)

    @staticmethod
    def limit(m: Moments, strength: float) -> np.ndarray:
        """What the descent converges to."""
        mask = np.diag([0.0, *np.ones(len(m.xy) - 1)])
        return np.linalg.solve(m.xx / m.n + strength * mask, m.xy / m.n)


@dataclass(frozen=True)
class LogisticRegression(Classifier):
    """Binary cross-entropy by full-batch descent from zeros; labels are 0 and 1."""

    coefficients: tuple[float, ...]
    losses: tuple[float, ...]
    outcome: str
    rate: float = 0.1

    @classmethod
    def fit(cls, df: DataFrame, features: str, label: str, rate: float = 0.1, iterations: int = 1000, tolerance: float = 1e-6, cache: bool = True) -> LogisticRegression:
        rows = df.select(as_doubles(features).alias("x"), F.col(label).cast("double").alias("y")).na.drop()
        checked = rows.agg(F.count("*").alias("n"), F.bool_and(F.col("y").isin(0.0, 1.0)).alias("fine"), F.max(F.size("x")).alias("p")).first()
        if not checked["n"] or not checked["fine"]:
            raise ValueError("labels must be 0 or 1, and there must be rows")
        n, p = checked["n"], checked["p"]
        if cache:
            rows = rows.persist()
        found: dict[bytes, tuple[float, np.ndarray]] = {}

        def at(w: np.ndarray) -> tuple[float, np.ndarray]:
            """Loss and gradient of one pass over the rows."""
            if w.tobytes() not in found:
                z = linear_column("x", w)
                q = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
                clamped = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), q))
                loss = F.sum(-(F.col("y") * F.log(clamped) + (1 - F.col("y")) * F.log(1 - clamped)))
                error = q - F.col("y")
                got = rows.agg(loss.alias("loss"), F.sum(error).alias("g"), *(F.sum(error * F.get("x", F.lit(k))).alias(f"g{k}") for k in range(p))).first()
                found.clear()
                found[w.tobytes()] = got["loss"] / n, np.array([got["g"], *(got[f"g{k}"] for k in range(p))]) / n
            return found[w.tobytes()]

        try:
            w, losses, outcome = descend(np.zeros(p + 1), lambda w: at(w)[0], lambda w: at(w)[1], rate, iterations, tolerance)
        finally:
            if cache:
                rows.unpersist()
        return cls(tuple(w.tolist()), tuple(losses), outcome, rate)

    def log_odds(self, features: str) -> Column:
        return linear_column(features, self.coefficients)

    def probability(self, features: str) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.log_odds(features)))

    def column(self, features: str) -> Column:
        return F.when(self.log_odds(features) >= 0, 1).otherwise(0)

    def predict(self, df: DataFrame, features: str, name: str = "predicted") -> DataFrame:
        return df.withColumn(name, self.column(features))

    def __str__(self) -> str:
        return f"LogisticRegression: {len(self.coefficients) - 1} features, {self.outcome} after {len(self.losses) - 1} iterations"


@dataclass(frozen=True)
class ResidualModel:
    """A regressor with what it leaves unexplained."""

    model: Regressor

    @property
    def coefficients(self) -> tuple[float, ...]:
        return self.model.coefficients

    def expected(self, df: DataFrame, features: list[str] | str, name: str = "expected") -> DataFrame:
        return self.model.predict(df, features, name)

    def residuals(self, df: DataFrame, features: list[str] | str, target: str, name: str = "residual") -> DataFrame:
        return df.withColumn(name, F.col(target).cast("double") - self.model.column(features))

    def __str__(self) -> str:
        return f"ResidualModel of {self.model}"
