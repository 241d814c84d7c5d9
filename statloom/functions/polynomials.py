"""Polynomials as ascending coefficients, their columns, and least-squares fits by normal equations in one pass."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.core import double

_SUPERSCRIPT = str.maketrans("0123456789-", "⁰¹²³⁴⁵⁶⁷⁸⁹⁻")


def format_number(x: float) -> str:
    """Up to four decimals without trailing zeros, all four where the number would look whole but isn't; small numbers in scientific form."""
    if not math.isfinite(x):
        return "NaN" if math.isnan(x) else "∞" if x > 0 else "-∞"
    if x and abs(x) < 1e-3:
        return f"{x:.3g}"
    if x == int(x):
        return str(int(x))
    text = f"{x:.4f}"
    short = text.rstrip("0")
    return text if short.endswith(".") else short


@dataclass(frozen=True)
class Polynomial:
    coefficients: tuple[float, ...]

    def __init__(self, coefficients):
        object.__setattr__(self, "coefficients", tuple(map(float, coefficients)) or (0.0,))

    @property
    def degree(self) -> int:
        return len(self.trimmed().coefficients) - 1

    def trimmed(self) -> Polynomial:
        c = list(self.coefficients)
        while len(c) > 1 and c[-1] == 0:
            c.pop()
        return Polynomial(c)

    def __call__(self, x):
        """The value at a number, at each of a list, or at a column."""
        if isinstance(x, (list, tuple)):
            return [self(v) for v in x]
        value = F.lit(0.0) if isinstance(x, Column) else 0.0
        for c in reversed(self.coefficients):
            value = value * x + c
        return value

    def derivative(self) -> Polynomial:
        return Polynomial([k * c for k, c in enumerate(self.coefficients)][1:])

    def __add__(self, other: Polynomial) -> Polynomial:
        n = max(len(self.coefficients), len(other.coefficients))
        a, b = (p.coefficients + (0.0,) * (n - len(p.coefficients)) for p in (self, other))
        return Polynomial([x + y for x, y in zip(a, b)]).trimmed()

    def __mul__(self, other: Polynomial | float) -> Polynomial:
        b = other.coefficients if isinstance(other, Polynomial) else (float(other),)
        return Polynomial(np.convolve(self.coefficients, b)).trimmed()

    __rmul__ = __mul__

    def expression(self, tolerance: float = 1e-12) -> str:
        """As text with superscripts; coefficients that are small beside the largest are left out."""
        least = tolerance * max(map(abs, self.coefficients))
        out = ""
        for k in range(len(self.coefficients) - 1, -1, -1):
            c = self.coefficients[k]
            if abs(c) <= least:
                continue
            size = format_number(abs(c))
            power = "" if k == 0 else "x" if k == 1 else "x" + str(k).translate(_SUPERSCRIPT)
            term = power if size == "1" and k else size + power
            out += (f" {'-' if c < 0 else '+'} " if out else "-" if c < 0 else "") + term
        return out or "0"

    __str__ = expression


def evaluate(coefficients: Column | str, x: Column | str) -> Column:
    """Horner's rule over a column of ascending coefficients."""
    c = F.col(coefficients) if isinstance(coefficients, str) else coefficients
    return F.aggregate(F.reverse(c), F.lit(0.0), lambda s, k: s * double(x) + k)


def derivative(coefficients: Column | str) -> Column:
    c = F.col(coefficients) if isinstance(coefficients, str) else coefficients
    return F.transform(F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda k, i: k * (i + 1))


def polyfit(df: DataFrame, x: str, y: str, degree: int) -> Polynomial | None:
    """Least squares; None if degree < 0, there are too few rows, or the system is singular. One aggregate of power sums."""
    if degree < 0:
        return None
    rows = df.select(double(x).alias("x"), double(y).alias("y")).na.drop()
    powers = [F.sum(F.pow("x", F.lit(float(k)))).alias(f"p{k}") for k in range(2 * degree + 1)]
    moments = [F.sum(F.col("y") * F.pow("x", F.lit(float(k)))).alias(f"m{k}") for k in range(degree + 1)]
    got = rows.agg(F.count("*").alias("n"), *powers, *moments).first()
    if got["n"] <= degree:
        return None
    a = np.array([[got[f"p{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    scale = np.sqrt(np.diag(a))
    if not (scale > 0).all() or np.linalg.cond(a / np.outer(scale, scale)) > 1e15:
        return None
    return Polynomial(np.linalg.solve(a, np.array([got[f"m{k}"] for k in range(degree + 1)])))
