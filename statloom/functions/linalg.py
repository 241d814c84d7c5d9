"""Kernels for small dense matrices as values, and as columns of matrices.

Pivots below 1000 units in the last place of 1 count as zero from three rows on, as an absolute bound.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The absolute size below which a pivot counts as zero.
LEAST_PIVOT = 1000 * sys.float_info.epsilon


class MatrixError(ValueError):
    """A matrix that an operation isn't defined for."""


class NotSquare(MatrixError):
    def __init__(self) -> None:
        super().__init__("the matrix is not square")


class Singular(MatrixError):
    def __init__(self) -> None:
        super().__init__("the matrix is singular")


def _square(matrix) -> np.ndarray:
    a = np.array(matrix, float)
    if a.ndim != 2 or a.shape[0] != a.shape[1] or not a.size:
        raise NotSquare
    return a


@dataclass(frozen=True)
class LU:
    """P A = L U by partial pivoting; permutation[i] is the row of A that came to row i."""

    lower: np.ndarray
    upper: np.ndarray
    permutation: np.ndarray
    sign: int

    @property
    def determinant(self) -> float:
        return float(self.sign * np.prod(np.diag(self.upper)))

    def solve(self, b) -> np.ndarray:
        b = np.array(b, float)
        if len(b) != len(self.lower):
            raise MatrixError("the right side has another length")
        y = b[self.permutation].copy()
        for i in range(len(y)):
            y[i] -= self.lower[i, :i] @ y[:i]
        for i in range(len(y) - 1, -1, -1):
            y[i] = (y[i] - self.upper[i, i + 1 :] @ y[i + 1 :]) / self.upper[i, i]
        return y


def lu(matrix) -> LU:
    u = _square(matrix)
    n = len(u)
    lower, order, sign = np.eye(n), np.arange(n), 1
    for k in range(n):
        p = k + int(np.argmax(np.abs(u[k:, k])))
        if abs(u[p, k]) < LEAST_PIVOT:
            raise Singular
        if p != k:
            u[[k, p]], order[[k, p]] = u[[p, k]], order[[p, k]]
            lower[[k, p], :k] = lower[[p, k], :k]
            sign = -sign
        lower[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
        u[k + 1 :] -= np.outer(lower[k + 1 :, k], u[k])
        u[k + 1 :, k] = 0
    return LU(lower, u, order, sign)


def determinant(matrix) -> float:
    a = _square(matrix)
    if len(a) == 1:
        return float(a[0, 0])
    if len(a) == 2:
        return float(a[0, 0] * a[1, 1] - a[0, 1] * a[1, 0])
    try:
        return lu(a).determinant
    except Singular:
        return 0.0


@dataclass(frozen=True)
class LogDeterminant:
    sign: float
    log_abs: float

    @property
    def value(self) -> float:
        return self.sign * math.exp(self.log_abs)


def log_determinant(matrix) -> LogDeterminant:
    """Sign and logarithm of the absolute determinant; sign 0 and -inf if singular."""
    try:
        found = lu(matrix)
    except Singular:
        return LogDeterminant(0.0, -math.inf)
    diagonal = np.diag(found.upper)
    return LogDeterminant(float(found.sign * np.prod(np.sign(diagonal))), float(np.log(np.abs(diagonal)).sum()))


def inverse(matrix) -> np.ndarray:
    a = _square(matrix)
    found = lu(a)
    return np.array([found.solve(e) for e in np.eye(len(a))]).T


def condition_number(matrix) -> float:
    """In the 1-norm; infinite if singular."""
    a = _square(matrix)
    try:
        return float(np.abs(a).sum(0).max() * np.abs(inverse(a)).sum(0).max())
    except Singular:
        return math.inf


def solve(matrix, b) -> list[float] | None:
    """x with matrix x = b; None if it isn't square, fits b not, or is singular."""
    try:
        a = _square(matrix)
        return None if len(b) != len(a) else lu(a).solve(b).tolist()
    except MatrixError:
        return None


def _matrix(cell) -> np.ndarray:
    return np.array([np.array(r, float) for r in cell])


def column(f: Callable, kind: str = "double") -> Callable[..., Column]:
    """f of a matrix column (and further columns) in Arrow batches: ``column(determinant)("m")``."""

    @F.pandas_udf(kind)
    def one(m: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else _plain(f(_matrix(c))) for c in m])

    @F.pandas_udf(kind)
    def two(m: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if c is None or d is None else _plain(f(_matrix(c), list(d))) for c, d in zip(m, b)])

    return lambda m, b=None: one(m) if b is None else two(m, b)


def _plain(value):
    return value.tolist() if isinstance(value, np.ndarray) else value
