"""Series formulas on window arrays (#77-#90), lifted from inside the forecasting networks with
fixed parameters. Each takes a 1-D ``array<double>`` window column and returns a column.

Formulas that look at a whole window per element (averages, recurrences, spectra) are Arrow-batched
pandas UDFs that run numpy on all windows of a batch at once; the others are array expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# The pandas UDFs below are shipped by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


_DOUBLES = T.ArrayType(T.DoubleType())


def _batches(columns: Sequence[pd.Series]):
    """The rows of a batch that have values, by length: (places in the batch, one matrix per column).
    A null row, or a null in one of its columns, gives no result."""
    places: dict[tuple[int, ...], list[int]] = {}
    for i, row in enumerate(zip(*columns)):
        if all(v is not None for v in row):
            places.setdefault(tuple(len(v) for v in row), []).append(i)
    for at in places.values():
        yield at, [np.array([c.iloc[i] for i in at], dtype=np.float64).reshape(len(at), -1) for c in columns]


def _by_matrix(kernel, *columns: str | Column) -> Column:
    """``kernel`` applied to all windows of a batch at once: matrices (window × time) in, matrix out."""
    n = len(columns)

    def run(parts: Sequence[pd.Series]) -> pd.Series:
        out = [None] * len(parts[0])
        for at, matrices in _batches(parts):
            for i, row in zip(at, kernel(*matrices)):
                out[i] = row
        return pd.Series(out, dtype=object)

    if n == 1:
        @F.pandas_udf(_DOUBLES)
        def one(x: pd.Series) -> pd.Series:
            return run([x])

        return one(_c(columns[0]))

    @F.pandas_udf(_DOUBLES)
    def three(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return run([x, y, z])

    return three(*map(_c, columns))


# ----------------------------------------------------------------------- decomposition

def moving_average(x: str | Column, k: int) -> Column:
    """Centred moving average of odd size ``k``; the ends replicate the first/last value."""
    if k < 1 or k % 2 == 0:
        raise ValueError("moving average needs an odd kernel size")

    def kernel(m: np.ndarray) -> np.ndarray:
        if not m.shape[1]:
            return m
        padded = np.pad(m, ((0, 0), (k // 2, k // 2)), mode="edge")
        return np.lib.stride_tricks.sliding_window_view(padded, k, axis=1).mean(axis=2)

    return _by_matrix(kernel, x)


def decompose(x: str | Column, k: int) -> Column:
    """``struct(seasonal, trend)`` with trend = moving average and seasonal = x − trend."""
    a = _c(x)
    trend = moving_average(a, k)
    return F.struct(F.zip_with(a, trend, lambda u, v: u - v).alias("seasonal"), trend.alias("trend"))


def decompose_multi(x: str | Column, kernels: Sequence[int]) -> Column:
    """Average of the decompositions over several kernel sizes."""
    a = _c(x)
    trends = [moving_average(a, k) for k in kernels]
    total = trends[0]
    for t in trends[1:]:
        total = F.zip_with(total, t, lambda u, v: u + v)
    trend = F.transform(total, lambda v: v / F.lit(float(len(kernels))))
    return F.struct(F.zip_with(a, trend, lambda u, v: u - v).alias("seasonal"), trend.alias("trend"))


def difference(x: str | Column, start: float | Column = 0.0) -> Column:
    """First difference with a given start value: ``[x0 - start, x1 - x0, ...]``."""
    a = _c(x)
    s = start if isinstance(start, Column) else F.lit(float(start))
    return F.transform(a, lambda v, j: v - F.when(j == 0, s).otherwise(F.element_at(a, j)))


# ----------------------------------------------------------------------- smoothing

def _recurrence(w: float, v0: float, gain: np.ndarray) -> np.ndarray:
    """``s_t = w·s_{t-1} + gain_t`` along each row, all rows at once."""
    out, s = np.empty_like(gain), np.full(len(gain), float(v0))
    for t in range(gain.shape[1]):
        s = w * s + gain[:, t]
        out[:, t] = s
    return out


def exp_smooth(x: str | Column, alpha: float, v0: float = 0.0) -> Column:
    """``s_t = w^(t+1)·v0 + Σ_{j<=t} (1-w)·w^(t-j)·x_j`` with ``w = 1 - alpha``
    (the recurrence ``s_t = w·s_{t-1} + (1-w)·x_t``, ``s_{-1} = v0``)."""
    w = 1.0 - alpha
    return _by_matrix(lambda m: _recurrence(w, v0, (1.0 - w) * m), x)


def level_smooth(x: str | Column, season: str | Column, growth: str | Column, alpha: float, v0: float = 0.0) -> Column:
    """Level recurrence ``s_t = w·s_{t-1} + (1-w)·(x_t - season_t) + w·growth_t`` (``w = 1 - alpha``):
    exponential smoothing of x − season with growth added at weight ``w``."""
    w = 1.0 - alpha
    return _by_matrix(lambda m, season, growth: _recurrence(w, v0, (1.0 - w) * (m - season) + w * growth), x, season, growth)


def damped_trend(growth_last: str | Column, phi: float, horizon: int) -> Column:
    """``growth_last · Σ_{i=1..h} phi^i`` for h = 1..horizon."""
    g = _c(growth_last).cast("double")
    cum = []
    total = 0.0
    for i in range(1, horizon + 1):
        total += phi ** i
        cum.append(total)
    return F.transform(F.array(*[F.lit(c) for c in cum]), lambda c: g * c)


# ----------------------------------------------------------------------- spectral

def _strongest(m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin numbers, coefficients) of each row's ``k`` strongest harmonics, strongest first.

    X_f = Σ_t x_t e^{-2πi f t / T}; a harmonic has a conjugate of its own, so 0 < f < T/2. Of equal
    magnitudes the lower frequency comes first.
    """
    harmonics = np.arange(1, (m.shape[1] + 1) // 2)
    coefficients = np.fft.rfft(m, axis=1)[:, harmonics]
    order = np.argsort(-np.abs(coefficients), axis=1, kind="stable")[:, :max(1, k)]
    return harmonics[order], np.take_along_axis(coefficients, order, axis=1)


def fourier_extrapolate(x: str | Column, k: int, pred_len: int) -> Column:
    """Seasonal extrapolation: the ``k`` strongest non-DC frequencies extended ``pred_len`` steps,
    ``y_s = (2/T) Σ_f Re(X_f e^{2πi f s / T})`` for s = 0 .. T + pred_len - 1."""

    def kernel(m: np.ndarray) -> np.ndarray:
        length = m.shape[1]
        y = np.zeros((len(m), length + pred_len))
        turn = 2j * np.pi * np.arange(length + pred_len) / max(1, length)
        bins, coefficients = _strongest(m, k)
        for f, c in zip(bins.T, coefficients.T):  # one harmonic of every window at a time
            y += (c[:, None] * np.exp(f[:, None] * turn)).real
        return 2.0 / max(1, length) * y

    return _by_matrix(kernel, x)


_HARMONICS = T.StructType([T.StructField(n, _DOUBLES) for n in ("freq", "amplitude", "phase")])


def top_frequencies(x: str | Column, k: int) -> Column:
    """``array<struct<freq, amplitude, phase>>`` of the ``k`` strongest non-DC components
    (amplitude = |X_f|, the FFT magnitude; phase = angle of X_f)."""

    @F.pandas_udf(_HARMONICS)
    def harmonics(s: pd.Series) -> pd.DataFrame:
        out = {n: [None] * len(s) for n in _HARMONICS.names}
        for at, (m,) in _batches([s]):
            bins, coefficients = _strongest(m, k)
            for name, values in zip(_HARMONICS.names, (bins / max(1, m.shape[1]), np.abs(coefficients), np.angle(coefficients))):
                for i, row in zip(at, values):
                    out[name][i] = row
        return pd.DataFrame({n: pd.Series(v, dtype=object) for n, v in out.items()})

    h = harmonics(_c(x))
    return F.transform(F.arrays_zip(*(h[n].alias(n) for n in _HARMONICS.names)),
                       lambda z: F.struct(*(z[n].alias(n) for n in _HARMONICS.names)))


def kept_modes(length: int, modes: int, mode_select: str = "lowest", seed: int = 0) -> np.ndarray:
    """Numbers of the Fourier modes to keep, of the ``length // 2`` below the Nyquist frequency: the
    lowest ``modes``, or as many drawn without replacement by a seeded generator."""
    below = length // 2
    if mode_select == "random":
        return np.sort(np.random.default_rng(seed).permutation(below)[:modes])
    return np.arange(min(modes, below))


def lowpass(x: str | Column, modes: int, mode_select: str = "lowest", seed: int = 0) -> Column:
    """Keep ``min(modes, L // 2)`` Fourier modes (the lowest, DC included, or a seeded random
    choice), zero the rest, invert."""

    def kernel(m: np.ndarray) -> np.ndarray:
        length = m.shape[1]
        spectrum, keep = np.fft.rfft(m, axis=1), kept_modes(length, modes, mode_select, seed)
        kept = np.zeros_like(spectrum)
        kept[:, keep] = spectrum[:, keep]
        return np.fft.irfft(kept, n=length, axis=1)

    return _by_matrix(kernel, x)


def autocorrelation(x: str | Column) -> Column:
    """Circular autocorrelation ``R(τ) = Σ_t x_t · x_{(t+τ) mod L}``, by the power spectrum."""
    return _by_matrix(lambda m: np.fft.irfft(np.abs(np.fft.rfft(m, axis=1)) ** 2, n=m.shape[1], axis=1), x)


def top_lags(corr: str | Column, factor: float, length: int) -> Column:
    """The ``int(factor·ln L)`` lags with the largest correlation and their softmax weights:
    ``array<struct<lag, weight>>`` (strongest first)."""
    k = max(1, int(factor * math.log(length)))
    c = _c(corr)
    indexed = F.transform(c, lambda v, j: F.struct((-v).alias("neg"), j.alias("lag"), v.alias("v")))
    top = F.slice(F.array_sort(indexed), 1, k)
    mx = F.element_at(top, 1)["v"]
    denom = F.aggregate(top, F.lit(0.0), lambda acc, s: acc + F.exp(s["v"] - mx))
    return F.transform(top, lambda s: F.struct(s["lag"].alias("lag"), (F.exp(s["v"] - mx) / denom).alias("weight")))


def roll(x: str | Column, lag: Column) -> Column:
    """``x`` rotated left by ``lag`` (``torch.roll(x, -lag)``)."""
    a = _c(x)
    n = F.size(a)
    return F.transform(a, lambda v, j: F.element_at(a, ((j + lag) % n) + 1))


def time_delay_aggregate(x: str | Column, lags: str | Column) -> Column:
    """Σ_i weight_i · roll(x, -lag_i) over the ``top_lags`` structs."""
    a = _c(x)
    ls = _c(lags)
    n = F.size(a)
    return F.transform(a, lambda v, j: F.aggregate(
        ls, F.lit(0.0), lambda acc, s: acc + s["weight"] * F.element_at(a, ((j + s["lag"]) % n) + 1)))


def augment(x: str | Column, sigma: float, seed: int, key: str | Column) -> Column:
    """jitter(shift(scale(x))) with Gaussian noise; deterministic per (seed, key, position).

    Noise is the Box–Muller transform of two uniform numbers, the first 13 hex digits of an MD5 each,
    so a recomputed task (and any other engine) gives the same values.
    """
    a = _c(x)
    k = _c(key).cast("string")

    def gauss(tag: str, pos: Column | None = None) -> Column:
        parts = [F.lit(str(seed)), F.lit(tag), k] + ([pos.cast("string")] if pos is not None else [])
        uniform = [F.conv(F.substring(F.md5(F.concat_ws(":", *parts, F.lit(u))), 1, 13), 16, 10).cast("double") for u in ("u1", "u2")]
        u1, u2 = (uniform[0] + 1.0) / float((1 << 52) + 1), uniform[1] / float(1 << 52)
        return F.sqrt(-2.0 * F.log(u1)) * F.cos(2 * math.pi * u2)

    scale = gauss("scale") * sigma + 1.0
    shift = gauss("shift") * sigma
    return F.transform(a, lambda v, j: v * scale + shift + gauss("jitter", j) * sigma)
