"""Vectors and small matrices as array columns: element-wise arithmetic, products, norms, projections, masks and generators.

All are column expressions over Spark's higher-order functions. Vectors are read as doubles. Operations of two vectors need equal lengths
and raise an error otherwise; so does a division by zero.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.core import INF, col, ieee_divide, ieee_log, ieee_log10

Vector = Column | str


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it: what a lambda refers to is else computed for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def as_doubles(v: Vector) -> Column:
    return F.transform(col(v), lambda x: x.cast("double"))


def as_matrix(m: Vector) -> Column:
    return F.transform(col(m), lambda r: F.transform(r, lambda x: x.cast("double")))


def arrow_matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """The rows of a batch's column of vectors, all of one size and none null, as a matrix; null elements are NaN."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def literal(values: list) -> Column:
    """A vector or matrix of numbers as a constant column."""
    return F.array(*(literal(v) if isinstance(v, (list, tuple)) else F.lit(float(v)) for v in values))


def _same_size(a: Column, b: Column, then: Column) -> Column:
    return F.when(F.size(a) == F.size(b), then).otherwise(F.raise_error(F.lit("vectors differ in length")))


def combine(a: Vector, b: Vector, f: Callable[[Column, Column], Column]) -> Column:
    """f of the elements of two vectors of one length."""
    x, y = as_doubles(a), as_doubles(b)
    return _same_size(x, y, F.zip_with(x, y, f))


def combine_matrices(a: Vector, b: Vector, f: Callable[[Column, Column], Column]) -> Column:
    x, y = as_matrix(a), as_matrix(b)
    return _same_size(x, y, F.zip_with(x, y, lambda r, s: _same_size(r, s, F.zip_with(r, s, f))))


def add(a: Vector, b: Vector) -> Column:
    return combine(a, b, lambda x, y: x + y)


def subtract(a: Vector, b: Vector) -> Column:
    return combine(a, b, lambda x, y: x - y)


def multiply(a: Vector, b: Vector) -> Column:
    return combine(a, b, lambda x, y: x * y)


def divide(a: Vector, b: Vector) -> Column:
    return combine(a, b, _checked_divide)


def _checked_divide(x: Column, y: Column) -> Column:
    return F.when(y == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(F.try_divide(x, y))


def broadcast(v: Vector, value: float | Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of each element and one value: the scalar operators, and any caller's operation built of columns."""
    y = value if isinstance(value, Column) else F.lit(float(value))
    return F.transform(as_doubles(v), lambda x: f(x, y))


def broadcast_add(v: Vector, value) -> Column:
    return broadcast(v, value, lambda x, y: x + y)


def broadcast_subtract(v: Vector, value) -> Column:
    return broadcast(v, value, lambda x, y: x - y)


def broadcast_multiply(v: Vector, value) -> Column:
    return broadcast(v, value, lambda x, y: x * y)


def broadcast_divide(v: Vector, value) -> Column:
    return broadcast(v, value, _checked_divide)


def scalar_subtract(value, v: Vector) -> Column:
    return broadcast(v, value, lambda x, y: y - x)


def scalar_divide(value, v: Vector) -> Column:
    return broadcast(v, value, lambda x, y: _checked_divide(y, x))


def broadcast_matrix(m: Vector, value, f: Callable[[Column, Column], Column]) -> Column:
    y = value if isinstance(value, Column) else F.lit(float(value))
    return F.transform(as_matrix(m), lambda r: F.transform(r, lambda x: f(x, y)))


def scalar_divide_matrix(value, m: Vector) -> Column:
    """value / m, with IEEE results where an element is zero."""
    return broadcast_matrix(m, value, lambda x, y: ieee_divide(y, x))


def broadcast_rows(m: Vector, v: Vector, f: Callable[[Column, Column], Column] = lambda x, y: x + y) -> Column:
    """f of every row of a matrix and a vector of the rows' length."""
    return F.transform(as_matrix(m), lambda r: combine(r, v, f))


def broadcast_columns(m: Vector, v: Vector, f: Callable[[Column, Column], Column] = lambda x, y: x + y) -> Column:
    """f of every column of a matrix and a vector of the columns' length."""
    x, y = as_matrix(m), as_doubles(v)
    return _same_size(x, y, F.zip_with(x, y, lambda r, s: F.transform(r, lambda e: f(e, s))))


def _fold(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Vector, b: Vector) -> Column:
    return _fold(combine(a, b, lambda x, y: x * y))


def magnitude(v: Vector) -> Column:
    return F.sqrt(_fold(F.transform(as_doubles(v), lambda x: x * x)))


def normalized(v: Vector) -> Column:
    """The unit vector; zeros for a zero vector."""
    return let(magnitude(v), lambda n: F.transform(as_doubles(v), lambda x: F.when(n > 0, F.try_divide(x, n)).otherwise(F.lit(0.0))))


def distance(a: Vector, b: Vector) -> Column:
    return F.sqrt(_fold(combine(a, b, lambda x, y: (x - y) * (x - y))))


def cosine(a: Vector, b: Vector) -> Column:
    """Cosine of the angle; 0 if a vector is zero."""
    n = magnitude(a) * magnitude(b)
    return F.when(n > 0, F.try_divide(dot(a, b), n)).otherwise(F.lit(0.0))


def angle(a: Vector, b: Vector) -> Column:
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine(a, b))))


def angle_degrees(a: Vector, b: Vector) -> Column:
    return F.degrees(angle(a, b))


def _target(n: Column, then: Column) -> Column:
    return F.when(n == 0, F.raise_error(F.lit("projection on a zero vector")).cast("double")).otherwise(then)


def scalar_projection(a: Vector, onto: Vector) -> Column:
    n = magnitude(onto)
    return _target(n, F.try_divide(dot(a, onto), n))


def vector_projection(a: Vector, onto: Vector) -> Column:
    share = let(dot(onto, onto), lambda n: _target(n, F.try_divide(dot(a, onto), n)))
    return let(share, lambda k: F.transform(as_doubles(onto), lambda x: x * k))


def orthogonal_component(a: Vector, to: Vector) -> Column:
    return subtract(a, vector_projection(a, to))


def matrix_vector(m: Vector, v: Vector) -> Column:
    return F.transform(as_matrix(m), lambda r: dot(r, v))


def matrix_column(m: Vector, index: int) -> Column:
    return F.transform(as_matrix(m), lambda r: F.get(r, F.lit(index)))


def transpose(m: Vector) -> Column:
    def flip(x: Column) -> Column:
        width = F.size(F.get(x, F.lit(0)))
        even = F.array_min(F.transform(x, F.size)) == F.array_max(F.transform(x, F.size))
        flipped = F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.transform(x, lambda r: F.get(r, j)))
        return F.when(even, flipped).otherwise(F.raise_error(F.lit("rows differ in length")))

    return let(as_matrix(m), flip)


def matrix_product(a: Vector, b: Vector) -> Column:
    return let(transpose(b), lambda y: F.transform(as_matrix(a), lambda r: F.transform(y, lambda c: dot(r, c))))


def shape(m: Vector) -> Column:
    x = col(m)
    return F.struct(F.size(x).alias("rows"), F.coalesce(F.size(F.get(x, F.lit(0))), F.lit(0)).alias("columns"))


def cells(m: Vector) -> Column:
    return F.aggregate(col(m), F.lit(0), lambda s, r: s + F.size(r))


def flattened(m: Vector) -> Column:
    return F.flatten(as_matrix(m))


def reshaped(v: Vector, rows: int, columns: int) -> Column:
    x = as_doubles(v)
    cut = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(x, i * columns + 1, F.lit(columns)))
    return F.when(F.size(x) == rows * columns, cut).otherwise(F.raise_error(F.lit("the count doesn't fit the shape")))


# Generators


def full(n: int, value: float) -> Column:
    return F.array_repeat(F.lit(float(value)), n)


def zeros(n: int) -> Column:
    return full(n, 0)


def ones(n: int) -> Column:
    return full(n, 1)


def full_matrix(rows: int, columns: int, value: float) -> Column:
    return F.array_repeat(full(columns, value), rows)


def diagonal(v: Vector) -> Column:
    def spread(x: Column) -> Column:
        side = F.sequence(F.lit(0), F.size(x) - 1)
        return F.transform(x, lambda e, i: F.transform(side, lambda j: F.when(i == j, e).otherwise(F.lit(0.0))))

    return let(as_doubles(v), spread)


def identity(n: int) -> Column:
    if n < 1:
        raise ValueError("identity needs a positive size")
    return diagonal(ones(n))


def arange(start: float, stop: float, step: float = 1.0) -> Column:
    """start, start + step, ... before stop (the product form, which gathers no rounding error)."""
    if step == 0:
        raise ValueError("step must not be 0")
    n = max(0, math.ceil((stop - start) / step))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(start)) + i * F.lit(float(step))) if n else F.array().cast("array<double>")


def linspace(start: float, end: float, count: int) -> Column:
    if count < 1:
        raise ValueError("linspace needs a positive count")
    if count == 1:
        return F.array(F.lit(float(start)))
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.lit(float(start)) + i * F.lit((end - start) / (count - 1)))


# Masks


def _ordered(x: Column, y: Column, holds: Column) -> Column:
    """A comparison that is false with NaN, as in IEEE arithmetic."""
    return holds & ~F.isnan(x) & ~F.isnan(y)


def equal(a: Vector, b: Vector) -> Column:
    return combine(a, b, lambda x, y: _ordered(x, y, x == y))


def compare(v: Vector, how: str, value: float) -> Column:
    """Mask of the elements that are ``>``, ``<``, ``>=`` or ``<=`` value."""
    holds = {">": lambda x, y: x > y, "<": lambda x, y: x < y, ">=": lambda x, y: x >= y, "<=": lambda x, y: x <= y}[how]
    return broadcast(v, value, lambda x, y: _ordered(x, y, holds(x, y)))


def mask_and(a: Vector, b: Vector) -> Column:
    return _same_size(col(a), col(b), F.zip_with(col(a), col(b), lambda x, y: x & y))


def mask_or(a: Vector, b: Vector) -> Column:
    return _same_size(col(a), col(b), F.zip_with(col(a), col(b), lambda x, y: x | y))


def mask_not(a: Vector) -> Column:
    return F.transform(col(a), lambda x: ~x)


def true_indices(mask: Vector) -> Column:
    m = col(mask)
    return F.when(F.size(m) == 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: F.get(m, i)))


def masked(v: Vector, mask: Vector) -> Column:
    x, m = col(v), col(mask)
    return _same_size(x, m, F.filter(x, lambda _, i: F.get(m, i)))


def masked_with_indices(v: Vector, mask: Vector) -> Column:
    x, m = col(v), col(mask)
    return _same_size(x, m, F.filter(F.transform(x, lambda e, i: F.struct(i.alias("index"), e.alias("value"))), lambda _, i: F.get(m, i)))


def choose(mask: Vector, a: Vector, b: Vector) -> Column:
    m, x, y = col(mask), col(a), col(b)
    picked = F.transform(x, lambda e, i: F.when(F.get(m, i), e).otherwise(F.get(y, i)))
    return _same_size(x, m, _same_size(x, y, picked))


# Element-wise mathematics: functions of a number column, and of each element of a vector


def _round(x: Column) -> Column:
    """To the nearest whole number, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def _whole(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(F.isnan(x) | (F.abs(x) == INF), x).otherwise(f(x).cast("double"))


MATH: dict[str, Callable[[Column], Column]] = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "floor": _whole(F.floor), "ceil": _whole(F.ceil), "round": _whole(_round),
    "log": ieee_log, "log10": ieee_log10, "exp": F.exp, "sqrt": F.sqrt, "square": lambda x: x * x,
    "sigmoid": lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)),
}


def elementwise(v: Vector, name: str) -> Column:
    return F.transform(as_doubles(v), lambda x: MATH[name](x))


def power(v: Vector, exponent: float) -> Column:
    return F.transform(as_doubles(v), lambda x: F.pow(x, F.lit(float(exponent))))


def rounded(x: Column | str, places: int) -> Column:
    """x scaled, rounded to a whole number (halves away from zero) and scaled back."""
    scale = F.lit(10.0**places)
    return MATH["round"](col(x).cast("double") * scale) / scale


def softmax(v: Vector) -> Column:
    """exp(x - max) over its sum; an empty vector stays empty; all equal if the sum is not finite."""

    def shares(raised: Column) -> Column:
        def over(total: Column) -> Column:
            fine = ~F.isnan(total) & (total != INF) & (total > 0)
            return F.transform(raised, lambda e: F.when(fine, F.try_divide(e, total)).otherwise(F.lit(1.0) / F.size(raised)))

        return let(_fold(raised), over)

    def raise_all(x: Column) -> Column:
        return let(F.array_max(x), lambda top: F.transform(x, lambda e: F.exp(e - top)))

    return let(let(as_doubles(v), raise_all), shares)


def sigmoid(v: Vector) -> Column:
    return elementwise(v, "sigmoid")


# Sparse matrices as rows (i, j, v)


def multiply_tall(a, b):
    """Product of two matrices given as rows (i, j, v): a join on the inner index and a sum, for matrices of any size."""
    left = a.select(F.col("i"), F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


