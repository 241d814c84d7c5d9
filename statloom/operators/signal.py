"""Fourier transforms and power spectra of series held as (position, x) rows.

A table taken as one series (no ``by``) is transformed in six steps, whatever its length n: its samples are a matrix of about sqrt(n)
columns, which tasks transform a block of columns at a time; the results are turned by the twiddle factors and shuffled into rows, and
tasks transform a block of rows at a time. No task holds more than GROUP values, or two columns' or rows' worth if that is more. Of the series that
``by`` separates, each comes together in one task and takes one numpy transform.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.core import double, with_position, with_stats

#: Values of a block of columns or rows that a task transforms at once.
GROUP = 1 << 18


def next_power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def is_power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def padded(x: np.ndarray, value: float = 0.0) -> np.ndarray:
    return np.concatenate([x, np.full(next_power_of_two(len(x)) - len(x), value)]) if len(x) else x


def hann(n: int) -> np.ndarray:
    """The symmetric window."""
    return 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / (n - 1))) if n > 1 else np.ones(n)


def _even(x: np.ndarray) -> np.ndarray:
    if not is_power_of_two(len(x)):
        raise ValueError("the number of samples must be a power of two")
    return x


def magnitude(x: np.ndarray) -> np.ndarray:
    return np.abs(np.fft.fft(_even(x)))


def magnitude_half(x: np.ndarray) -> np.ndarray:
    return magnitude(x)[: len(x) // 2]


def phase(x: np.ndarray) -> np.ndarray:
    return np.angle(np.fft.fft(_even(x)))


def frequencies(n: int, sample_rate: float) -> np.ndarray:
    return np.arange(n) * sample_rate / n


def inverse(x: np.ndarray) -> np.ndarray:
    """Of a spectrum of real numbers (imaginary parts 0): the real part."""
    return np.fft.ifft(_even(x)).real


def spectrum(x: np.ndarray, sample_rate: float, windowed: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and magnitudes of the first half, the series being windowed if asked for and padded to a power of two."""
    y = padded(x * hann(len(x)) if windowed else x)
    half = len(y) // 2
    return frequencies(len(y), sample_rate)[:half], np.abs(np.fft.fft(y))[:half]


@dataclass(frozen=True)
class PowerSpectrum:
    sample_rate: float
    frequencies: np.ndarray
    densities: np.ndarray

    @property
    def dominant_frequency(self) -> float:
        """Of the highest density beside that of 0; 0 under two bins."""
        return float(self.frequencies[1 + int(np.argmax(self.densities[1:]))]) if len(self.densities) > 1 else 0.0

    def band_energy(self, low: float, high: float) -> float:
        if len(self.frequencies) < 2:
            return 0.0
        inside = (self.frequencies >= low) & (self.frequencies <= high)
        return float(self.densities[inside].sum() * (self.frequencies[1] - self.frequencies[0]))

    def __str__(self) -> str:
        return f"PowerSpectrum: {len(self.frequencies)} bins, dominant {self.dominant_frequency:.4g} Hz"


def power_spectral_density(x: np.ndarray, sample_rate: float, windowed: bool = False) -> PowerSpectrum | None:
    """One-sided density; None under two samples. Windowed: over the energy of the window of the unpadded length."""
    n = len(x)
    if n < 2 or sample_rate <= 0:
        return None
    w = hann(n) if windowed else np.ones(n)
    y = padded(x * w)
    size = len(y)
    energy = sample_rate * (np.square(w).sum() if windowed else size)
    with np.errstate(divide="ignore", invalid="ignore"):
        density = np.square(np.abs(np.fft.fft(y)[: size // 2 + 1])) / energy
    density[1:-1] *= 2
    return PowerSpectrum(sample_rate, np.arange(size // 2 + 1) * sample_rate / size, density)


def dominant_frequency(x: np.ndarray, sample_rate: float) -> float | None:
    f, m = spectrum(x, sample_rate)
    return float(f[1 + int(np.argmax(m[1:]))]) if len(m) > 1 else None


# Distributed forms


def _per_series(df: DataFrame, x: str, order: str, by: tuple[str, ...], f: Callable[[np.ndarray], dict[str, np.ndarray]], columns: str) -> DataFrame:
    keys = list(by)
    rows = df.select(*by, F.col(order).alias("_order"), F.col(x).cast("double").alias("_x"))

    def run(series: pd.DataFrame) -> pd.DataFrame:
        made = pd.DataFrame(f(series.sort_values("_order")["_x"].to_numpy(float)))
        for k in keys:
            made[k] = series[k].iloc[0]
        return made

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInPandas(run, f"{columns}, {kinds}")


def _positioned(df: DataFrame, x: str, order: str) -> tuple[DataFrame, int]:
    """(position, x) of a whole table in order, and its number of rows. An order of 0, 1, ... is the position itself."""
    whole = df.schema[order].dataType.typeName() in ("byte", "short", "integer", "long")
    found = df.agg(F.count(F.lit(1)).alias("n"), *((F.min(order).alias("low"), F.max(order).alias("high")) if whole else ())).first()
    if whole and found["n"] and (found["low"], found["high"]) == (0, found["n"] - 1):
        return df.select(F.col(order).cast("long").alias("position"), double(x).alias("x")), found["n"]
    return with_position(df.select(F.col(order).alias("_order"), double(x).alias("x")), "_order").select("position", "x"), found["n"]


def _six_steps(rows: DataFrame, n: int, back: bool = False) -> DataFrame:
    """(bin, re, im) of the transform of rows (position, x) padded with zeros to n, a power of two; back: of the inverse transform.

    Of a position p = i * columns + j, the samples of one j are transformed first. Bin k + height * l is then place l of the transform of row k.
    """
    height = 1 << (n.bit_length() - 1) // 2
    columns = n // height
    transform, sign = (np.fft.ifft, 1) if back else (np.fft.fft, -1)
    wide, high = max(1, GROUP // height), max(1, GROUP // columns)  # columns, then rows, of a block

    def of_columns(part: pd.DataFrame) -> pd.DataFrame:
        first = int(part["block"].iloc[0]) * wide
        count = min(wide, columns - first)
        matrix = np.zeros((height, count))
        at = part["position"].to_numpy()
        matrix[at // columns, at % columns - first] = part["x"].to_numpy(float)
        k, j = np.arange(height)[:, None], np.arange(first, first + count)
        turned = transform(matrix, axis=0) * np.exp(sign * 2j * np.pi * (k * j % n) / n)
        return pd.DataFrame({"k": np.repeat(np.arange(height), count), "j": np.tile(j, height), "re": turned.real.ravel(), "im": turned.imag.ravel()})

    def of_rows(part: pd.DataFrame) -> pd.DataFrame:
        first = int(part["k"].iloc[0]) // high * high
        count = min(high, height - first)
        matrix = np.zeros((count, columns), complex)
        matrix[part["k"].to_numpy() - first, part["j"].to_numpy()] = part["re"].to_numpy() + 1j * part["im"].to_numpy()
        made = transform(matrix, axis=1)
        bins = np.arange(first, first + count)[:, None] + height * np.arange(columns)
        return pd.DataFrame({"bin": bins.ravel(), "re": made.real.ravel(), "im": made.imag.ravel()})

    blocks = rows.select("position", "x", F.floor(F.pmod("position", F.lit(columns)) / wide).cast("long").alias("block"))
    turned = blocks.groupBy("block").applyInPandas(of_columns, "k long, j long, re double, im double")
    found = turned.groupBy(F.floor(F.col("k") / high).alias("_rows")).applyInPandas(of_rows, "bin long, re double, im double")
    if back:
        return found
    # the sums of real samples at bin 0 and in the middle are real; rounding errors would give them a phase
    return found.withColumn("im", F.when((F.col("bin") == 0) | (F.col("bin") * 2 == n), 0.0).otherwise(F.col("im")))


_MAGNITUDE = "sqrt(re * re + im * im)"


def fourier(df: DataFrame, x: str, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(bin, magnitude, phase) of every bin."""
    if by:
        return _per_series(df, x, order, by, lambda v: {"bin": np.arange(len(v)), "magnitude": magnitude(v), "phase": phase(v)}, "bin long, magnitude double, phase double")
    rows, n = _positioned(df, x, order)
    return _six_steps(rows, _even_size(n)).select("bin", F.expr(_MAGNITUDE).alias("magnitude"), F.atan2("im", "re").alias("phase"))


def fourier_inverse(df: DataFrame, x: str, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    if by:
        return _per_series(df, x, order, by, lambda v: {"position": np.arange(len(v)), "value": inverse(v)}, "position long, value double")
    rows, n = _positioned(df, x, order)
    return _six_steps(rows, _even_size(n), back=True).select(F.col("bin").alias("position"), F.col("re").alias("value"))


def _even_size(n: int) -> int:
    if not is_power_of_two(n):
        raise ValueError("the number of samples must be a power of two")
    return n


def _windowed(rows: DataFrame, n: int, windowed: bool) -> DataFrame:
    weight = 0.5 * (1 - F.cos(F.col("position") * (2 * np.pi / (n - 1)))) if windowed and n > 1 else F.lit(1.0)
    return rows.withColumn("x", F.col("x") * weight)


def fourier_spectrum(df: DataFrame, x: str, order: str, sample_rate: float, windowed: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(frequency, magnitude) of the first half."""
    if by:
        return _per_series(df, x, order, by, lambda v: dict(zip(("frequency", "magnitude"), spectrum(v, sample_rate, windowed))), "frequency double, magnitude double")
    rows, n = _positioned(df, x, order)
    size = next_power_of_two(n) if n else 1
    half = _six_steps(_windowed(rows, n, windowed), size).where(F.col("bin") < size // 2)
    return half.select((F.col("bin") * (sample_rate / size)).alias("frequency"), F.expr(_MAGNITUDE).alias("magnitude"))


def density(df: DataFrame, x: str, order: str, sample_rate: float, windowed: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(bin, frequency, density); no rows for series under two samples; a density that isn't finite is null."""

    def run(v: np.ndarray) -> dict[str, np.ndarray]:
        found = power_spectral_density(v, sample_rate, windowed)
        if found is None:
            return {"bin": np.zeros(0, int), "frequency": np.zeros(0), "density": np.zeros(0)}
        return {"bin": np.arange(len(found.densities)), "frequency": found.frequencies, "density": np.where(np.isfinite(found.densities), found.densities, np.nan)}

    if by:
        made = _per_series(df, x, order, by, run, "bin long, frequency double, density double")
        return made.withColumn("density", F.when(~F.isnan("density"), F.col("density")))
    rows, n = _positioned(df, x, order)
    size = next_power_of_two(n) if n else 1
    # the squares of a window of four samples or more add up to 3 (n - 1) / 8
    energy = sample_rate * (size if not windowed else 3 * (n - 1) / 8 if n > 3 else float(np.square(hann(n)).sum()))
    sides = F.when((F.col("bin") == 0) | (F.col("bin") == size // 2), 1.0).otherwise(2.0)
    half = _six_steps(_windowed(rows, n, windowed), size).where((F.col("bin") <= size // 2) & F.lit(n > 1 and sample_rate > 0))
    value = F.try_divide(F.expr("re * re + im * im") * sides, F.lit(float(energy)))
    return half.select("bin", (F.col("bin") * (sample_rate / size)).alias("frequency"), F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value).alias("density"))


def hann_windowed(df: DataFrame, x: str, position: str, name: str = "windowed") -> DataFrame:
    """x times the window, for one series with 0-based positions."""
    n = F.col("_n")
    weight = F.when(n > 1, 0.5 * (1 - F.cos(F.lit(2 * np.pi) * F.col(position) / (n - 1)))).otherwise(F.lit(1.0))
    return with_stats(df, _n=F.count(F.lit(1))).withColumn(name, F.col(x) * weight).drop("_n")


def padded_rows(df: DataFrame, x: str, position: str, value: float = 0.0) -> DataFrame:
    """(position, x) with further rows up to a power of two of them."""
    n = df.count()
    more = df.sparkSession.range(n, next_power_of_two(n) if n else 0).select(F.col("id").alias(position), F.lit(float(value)).alias(x))
    return df.select(F.col(position).cast("long").alias(position), F.col(x).cast("double").alias(x)).unionByName(more)


def band_energy(spectrum: DataFrame, low: float, high: float, by: tuple[str, ...] = ()) -> DataFrame:
    """``energy`` of a density table between two frequencies, both included."""
    f = F.col("frequency")
    width = (F.max(f) - F.min(f)) / F.greatest(F.count(f) - 1, F.lit(1))
    return spectrum.groupBy(*by).agg((F.coalesce(F.sum(F.when(f.between(low, high), F.col("density"))), F.lit(0.0)) * width).alias("energy"))


def dominant(spectrum: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``dominant``: the frequency of the highest density beside that of bin 0, the lowest of equals; 0 under two bins."""
    best = F.max_by("frequency", F.when(F.col("bin") > 0, F.struct("density", (-F.col("bin")).alias("b"))))
    return spectrum.groupBy(*by).agg(F.when(F.max("bin") > 0, best).otherwise(F.lit(0.0)).alias("dominant"))
