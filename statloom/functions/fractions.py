"""Numbers as fractions of small denominators, found by walking the Stern-Brocot tree."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fraction:
    numerator: int
    denominator: int = 1

    def __post_init__(self) -> None:
        if self.denominator == 0:
            raise ValueError("the denominator must not be 0")
        g = math.gcd(self.numerator, self.denominator) * (1 if self.denominator > 0 else -1)
        object.__setattr__(self, "numerator", self.numerator // g)
        object.__setattr__(self, "denominator", self.denominator // g)

    @property
    def value(self) -> float:
        return self.numerator / self.denominator

    def __str__(self) -> str:
        return str(self.numerator) if self.denominator == 1 else f"{self.numerator}/{self.denominator}"

    @classmethod
    def of(cls, x: float, max_denominator: int = 1000, tolerance: float = 1e-9) -> Fraction:
        """The first fraction on the way to x that is within tolerance, or the nearest of those whose denominator is small enough."""
        whole = math.floor(x)
        rest = x - whole
        low, high, best = (0, 1), (1, 1), (0, 1)
        for candidate in (low, high):
            if abs(candidate[0] / candidate[1] - rest) < abs(best[0] / best[1] - rest):
                best = candidate
        while abs(best[0] / best[1] - rest) > tolerance:
            middle = (low[0] + high[0], low[1] + high[1])
            if middle[1] > max_denominator:
                break
            if abs(middle[0] / middle[1] - rest) < abs(best[0] / best[1] - rest):
                best = middle
            low, high = (middle, high) if middle[0] / middle[1] < rest else (low, middle)
        return cls(whole * best[1] + best[0], best[1])


def as_fractions(values: list, max_denominator: int = 1000, tolerance: float = 1e-9) -> list:
    """Fractions of the numbers of a vector or a matrix."""
    return [as_fractions(v, max_denominator, tolerance) if isinstance(v, (list, tuple)) else Fraction.of(v, max_denominator, tolerance) for v in values]


def fraction_column(x: Column, max_denominator: int = 1000, tolerance: float = 1e-9) -> Column:
    """struct(numerator, denominator); null for null, NaN and infinity."""

    @F.pandas_udf("struct<numerator: long, denominator: long>")
    def apply(s: pd.Series) -> pd.DataFrame:
        found = [Fraction.of(v, max_denominator, tolerance) if pd.notna(v) and math.isfinite(v) else None for v in s]
        return pd.DataFrame({n: pd.Series([f and getattr(f, n) for f in found], dtype="Int64") for n in ("numerator", "denominator")})

    return apply(x)
