"""Series formulas on rows (#77-#89): one row per value, a series of any length.

The formulas of ``operators.series`` for series that no array holds. Rows get a dense index over
(series, order); a bucket is a run of index positions, so a series with a third of all rows covers many
tasks and many short series share one.

* centred frames (averages, decompositions, differences): a row also goes to the buckets whose frames
  reach it; the ends of a series repeat its first and last value.
* recurrences: ``s -> w*s + g`` is an affine map; maps compose, so every bucket is one map, the maps are
  scanned in two levels (within runs of buckets, over the runs), and each bucket starts from its carry.
* spectra: the transform of any length is a convolution with a chirp, of a length that is a power of two,
  which is cut into residue classes (decimation in time): short transforms within classes, twiddle
  factors, short transforms across. Three shuffles of packed blocks, none of them larger than a task.
* lag sums: products of a bucket with itself and what follows it, the series' beginning after its end.

Null series keys are a series of their own. A null or NaN value makes the frames that hold it null,
leaves a recurrence where it is, and counts as zero in spectra and lag sums.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.operators.series import damped_trend, kept_modes
from tidepool.plans.order import auto_bucket_rows, join_group_stats, with_row_index, with_series_position
from tidepool.session import default_partitions

# Functions of this module travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_I, _B = "_tp_i", "_tp_b"
RUN_BUCKETS = 4096


def _value(x: str | Column) -> Column:
    return F.nanvl((F.col(x) if isinstance(x, str) else x).cast("double"), F.lit(None).cast("double"))


def _tasks(df: DataFrame, n: int, bucket_rows: int) -> int:
    return max(default_partitions(df.sparkSession), -(-n // bucket_rows))


# ----------------------------------------------------------------------- centred frames

def _centred(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str], half: int, columns, bucket_rows: int | None) -> DataFrame:
    """``df`` with ``columns(window)``: expressions over frames that reach up to ``half`` rows to either side."""
    indexed, n = with_row_index(df, [*partition_by, *order_by], _I)
    size = max(bucket_rows or auto_bucket_rows(df.sparkSession, n), half, 1)
    i, last = F.col(_I), max(0, n - 1) // size
    lo, hi = F.floor(F.greatest(i - half, F.lit(0)) / size), F.least(F.floor((i + half) / size), F.lit(last))
    staged = indexed.withColumn(_B, F.explode(F.sequence(lo, hi))).repartition(_tasks(df, n, size), _B)
    out = staged.select("*", *[c.alias(name) for name, c in columns(Window.partitionBy(_B, *partition_by).orderBy(_I)).items()])
    return out.where(F.col(_B) == F.floor(i / size)).drop(_I, _B)


def _average(x: Column, k: int, w) -> Column:
    half = k // 2
    frame, one = w.rowsBetween(-half, half), F.lit(1)
    left, right = (F.count(one).over(w.rowsBetween(*r)) if half else F.lit(0) for r in ((-half, -1), (1, half)))
    total = F.sum(x).over(frame) + (half - left) * F.first(x).over(frame) + (half - right) * F.last(x).over(frame)
    return F.when(F.count(x).over(frame) == F.count(one).over(frame), total / k)


def decompose_rows(df: DataFrame, value: str | Column, kernels: Sequence[int], order_by: Sequence[str], partition_by: Sequence[str] = (),
                   trend_col: str = "trend", seasonal_col: str = "seasonal", bucket_rows: int | None = None) -> DataFrame:
    """``df`` with the trend (the average of centred moving averages of the odd sizes ``kernels``, the ends
    of the series repeated) and the seasonal part (value less trend)."""
    if not kernels or any(k < 1 or k % 2 == 0 for k in kernels):
        raise ValueError("each kernel must have an odd size")
    x = _value(value)

    def columns(w) -> dict[str, Column]:
        trend = sum((_average(x, k, w) for k in kernels[1:]), _average(x, kernels[0], w)) / len(kernels)
        return {trend_col: trend, seasonal_col: x - trend}

    return _centred(df, order_by, partition_by, max(kernels) // 2, columns, bucket_rows)


def moving_average_rows(df: DataFrame, value: str | Column, k: int, order_by: Sequence[str], partition_by: Sequence[str] = (),
                        out_col: str = "trend", bucket_rows: int | None = None) -> DataFrame:
    """``df`` with the centred moving average of odd size ``k``; the ends of a series repeat."""
    return decompose_rows(df, value, [k], order_by, partition_by, out_col, "_tp_rest", bucket_rows).drop("_tp_rest")


def difference_rows(df: DataFrame, value: str | Column, order_by: Sequence[str], partition_by: Sequence[str] = (), start: float = 0.0,
                    out_col: str = "difference", bucket_rows: int | None = None) -> DataFrame:
    """``df`` with the first difference along each series; a series' first value is compared with ``start``."""
    x = _value(value)

    def columns(w) -> dict[str, Column]:
        is_first = F.count(F.lit(1)).over(w.rowsBetween(-1, -1)) == 0
        return {out_col: x - F.when(is_first, F.lit(float(start))).otherwise(F.lag(x).over(w))}

    return _centred(df, order_by, partition_by, 1, columns, bucket_rows)


# ----------------------------------------------------------------------- recurrences

def affine_scan(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``s_t = a_t * s_{t-1} + c_t`` with ``s_{-1} = 0``: maps composed over twice the distance each time."""
    a, c, reach = a.copy(), c.copy(), 1
    while reach < len(a) and a[reach:].any():
        c[reach:] += a[reach:] * c[:-reach]
        a[reach:] = a[reach:] * a[:-reach]
        reach *= 2
    return c


def _prefix_maps(a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.cumprod(a), affine_scan(a, c)


def _steps(group: pa.Table, w: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, c, key) of each row in order; a missing gain leaves the state as it is."""
    gain = group.column("_tp_g").to_numpy()
    known = ~np.isnan(gain)
    return np.where(known, w, 1.0), np.where(known, gain, 0.0), group.column("_tp_k").to_numpy()


_MAPS = "_tp_b bigint, first bigint, last bigint, whole boolean, a double, c double"


def _bucket_map(w: float, v0: float):
    def run(group: pa.Table) -> pa.Table:
        """The map from the state before the bucket to that behind it, for the series at its end."""
        group = group.sort_by(_I)
        a, c, key = _steps(group, w)
        begin = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        a, c = a[begin:].copy(), c[begin:].copy()
        if begin:  # the series begins here: what came before does not matter
            c[0], a[0] = a[0] * v0 + c[0], 0.0
        return pa.table({_B: [group.column(_B)[0]], "first": [int(key[0])], "last": [int(key[-1])], "whole": [begin == 0],
                         "a": [float(np.prod(a))], "c": [float(affine_scan(a, c)[-1])]})

    return run


def _run_maps(group: pa.Table) -> pa.Table:
    group = group.sort_by(_B)
    a, c = _prefix_maps(group.column("a").to_numpy(), group.column("c").to_numpy())
    return pa.table({"run": group.column("run"), _B: group.column(_B), "a": a, "c": c})


def _carries(maps: DataFrame, v0: float) -> DataFrame:
    """(_tp_b, key, state): the state behind the bucket before, and the series that it belongs to."""
    before = maps.select((F.col(_B) + 1).alias("_b"), F.col("last").alias("_k"))
    known = maps.join(before, F.col(_B) == F.col("_b"), "left")
    goes_on = F.col("whole") & F.col("_k").eqNullSafe(F.col("first"))
    steps = known.select(_B, "last", F.floor(F.col(_B) / RUN_BUCKETS).alias("run"), F.when(goes_on, F.col("a")).otherwise(0.0).alias("a"),
                         F.when(goes_on | ~F.col("whole"), F.col("c")).otherwise(F.col("a") * v0 + F.col("c")).alias("c"))
    inside = steps.groupBy("run").applyInArrow(_run_maps, "run bigint, _tp_b bigint, a double, c double")
    ends = inside.groupBy("run").agg(F.max_by("a", _B).alias("a"), F.max_by("c", _B).alias("c"))
    # one row for RUN_BUCKETS buckets of up to a million rows: the runs fit one task at any size
    over = ends.select(F.lit(0).cast("bigint").alias("run"), F.col("run").alias(_B), "a", "c").groupBy("run").applyInArrow(
        _run_maps, "run bigint, _tp_b bigint, a double, c double")
    start = over.select((F.col(_B) + 1).alias("r"), F.col("c").alias("s"))
    state = inside.join(start, F.col("run") == F.col("r"), "left").select(_B, (F.col("a") * F.coalesce("s", F.lit(0.0)) + F.col("c")).alias("state"))
    return state.join(steps.select(_B, "last"), _B).select((F.col(_B) + 1).alias(_B), F.col("last").alias("_tp_key"), F.col("state").alias("_tp_s"))


def _recur(w: float, v0: float, out_col: str):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by(_I)
        a, c, key = _steps(group, w)
        carried, state = group.column("_tp_key")[0].as_py(), group.column("_tp_s")[0].as_py()
        begin = np.r_[True, key[1:] != key[:-1]]
        into = np.full(int(begin.sum()), v0)
        if carried is not None and carried == key[0]:
            into[0] = state
        c[begin] += a[begin] * into
        a[begin] = 0.0
        out = group.drop_columns([_I, _B, "_tp_g", "_tp_k", "_tp_key", "_tp_s"])
        return out.append_column(out_col, pa.array(affine_scan(a, c)))

    return run


def linear_recurrence(df: DataFrame, gain: Column, w: float, v0: float, order_by: Sequence[str], partition_by: Sequence[str] = (),
                      out_col: str = "state", bucket_rows: int | None = None) -> DataFrame:
    """``df`` with ``s_t = w * s_{t-1} + gain_t`` along each series, ``s_{-1} = v0``; a missing gain
    leaves the state as it is."""
    key = F.xxhash64(*partition_by) if partition_by else F.lit(0).cast("bigint")
    staged = df.withColumns({"_tp_g": _value(gain), "_tp_k": key})
    indexed, n = with_row_index(staged, [*partition_by, *order_by], _I)
    size = bucket_rows or auto_bucket_rows(df.sparkSession, n)
    rows = indexed.withColumn(_B, F.floor(F.col(_I) / size))
    gains = rows.select(_I, _B, "_tp_k", F.coalesce("_tp_g", F.lit(float("nan"))).alias("_tp_g"))
    carries = _carries(gains.groupBy(_B).applyInArrow(_bucket_map(w, v0), _MAPS), v0)
    started = rows.withColumn("_tp_g", F.coalesce("_tp_g", F.lit(float("nan")))).join(carries, _B, "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out_col}` double"
    columns = [*df.columns, _I, _B, "_tp_g", "_tp_k", "_tp_key", "_tp_s"]
    return started.select(*[F.col(f"`{c}`") for c in columns]).groupBy(_B).applyInArrow(_recur(w, v0, out_col), schema)


def exp_smooth_rows(df: DataFrame, value: str | Column, alpha: float, order_by: Sequence[str], partition_by: Sequence[str] = (), v0: float = 0.0,
                    out_col: str = "level", bucket_rows: int | None = None) -> DataFrame:
    """``df`` with ``s_t = w * s_{t-1} + (1 - w) * x_t``, ``w = 1 - alpha``, along each series."""
    w = 1.0 - alpha
    return linear_recurrence(df, (1.0 - w) * _value(value), w, v0, order_by, partition_by, out_col, bucket_rows)


def level_smooth_rows(df: DataFrame, value: str | Column, season: str | Column, growth: str | Column, alpha: float, order_by: Sequence[str],
                      partition_by: Sequence[str] = (), v0: float = 0.0, out_col: str = "level", bucket_rows: int | None = None) -> DataFrame:
    """``df`` with the smoothing of value less season, growth added at weight ``w = 1 - alpha`` a step."""
    w = 1.0 - alpha
    return linear_recurrence(df, (1.0 - w) * (_value(value) - _value(season)) + w * _value(growth), w, v0, order_by, partition_by, out_col, bucket_rows)


def damped_trend_rows(df: DataFrame, growth: str | Column, phi: float, horizon: int, order_by: Sequence[str], partition_by: Sequence[str] = (),
                      out_col: str = "trend") -> DataFrame:
    """(series, step, trend): the last growth of each series times ``phi + ... + phi^step``, steps 1 to ``horizon``."""
    last = df.groupBy(*partition_by).agg(F.max_by(_value(growth), F.struct(*order_by)).alias("_tp_g"))
    return last.select(*partition_by, F.posexplode(damped_trend("_tp_g", phi, horizon)).alias("step", out_col)).withColumn("step", F.col("step") + 1)


# ----------------------------------------------------------------------- positions

def _positions(df: DataFrame, value: str | Column, order_by: Sequence[str], partition_by: Sequence[str]) -> tuple[DataFrame, DataFrame, int]:
    """(s, t, length, x) of every row, s the index of the series' first row; (s, keys); and the row count."""
    rows = df.select(*partition_by, *[c for c in order_by if c not in partition_by], F.coalesce(_value(value), F.lit(0.0)).alias("_tp_x"))
    indexed, n = with_row_index(rows, [*partition_by, *order_by], _I)
    placed = with_series_position(indexed, partition_by, _I, "_tp_t", "_tp_len", bucket_rows=auto_bucket_rows(df.sparkSession, n))
    at = placed.select((F.col(_I) - F.col("_tp_t")).alias("s"), F.col("_tp_t").alias("t"), F.col("_tp_len").alias("length"), F.col("_tp_x").alias("x"),
                       *[F.col(k).alias(f"_tp_k_{k}") for k in partition_by])
    keys = at.where("t = 0").select(F.col("s").alias("_tp_s"), *[F.col(f"_tp_k_{k}").alias(k) for k in partition_by])
    return at.select("s", "t", "length", "x"), keys, n


def _named(rows: DataFrame, keys: DataFrame, partition_by: Sequence[str], *columns: str | Column) -> DataFrame:
    if not partition_by:
        return rows.select(*columns)
    return rows.join(keys, F.col("s") == F.col("_tp_s")).select(*partition_by, *columns)


# ----------------------------------------------------------------------- spectra

SEGMENT_ROWS = 1 << 16  # series up to this length are transformed as one array
MOST_BLOCK = 1 << 20  # complex numbers a task holds of a longer one

_COEFFICIENTS = T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("re", "im")])
_SPECTRUM = "s bigint, length bigint, f bigint, re double, im double"


def chirp(t: np.ndarray, length: int) -> np.ndarray:
    """``exp(-i pi t^2 / length)``; the square is reduced by whole turns before it becomes a float."""
    t = t if length < 1 << 31 else t.astype(object)
    return np.exp(-1j * np.pi * ((t * t) % (2 * length)).astype(np.float64) / length)


def _shape(length: int) -> tuple[int, int, int, int]:
    """(classes, class length, class places a block, ... of the second half) of the padded transform."""
    bits = (2 * length - 2).bit_length()
    classes, each = 1 << bits // 2, 1 << bits - bits // 2
    block = min(MOST_BLOCK, max(1 << 12, (1 << bits) // 32))
    return classes, each, min(each, max(1, block // classes)), min(classes, max(1, block // each))


_FIRST = "s bigint, length bigint, j bigint, r bigint, a binary, b binary"


def _class_transforms(group: pa.Table) -> pa.Table:
    """One residue class of a series: its transform and that of the chirp, with twiddle factors, in blocks."""
    length, r = group.column("length")[0].as_py(), group.column("r")[0].as_py()
    classes, each, wide, _ = _shape(length)
    t = group.column("t").to_numpy()
    a = np.zeros(each, dtype=np.complex128)
    a[t // classes] = group.column("x").to_numpy() * chirp(t, length)
    at = r + classes * np.arange(each, dtype=np.int64)
    at = np.minimum(at, classes * each - at)  # the chirp is even
    b = np.where(at < length, chirp(at, length).conj(), 0.0)
    twiddle = np.exp(-2j * np.pi * r * np.arange(each) / (classes * each))
    a, b = (np.fft.fft(x) * twiddle for x in (a, b))
    blocks, s = range(0, each, wide), group.column("s")[0].as_py()
    return pa.table({"s": [s] * len(blocks), "length": [length] * len(blocks), "j": [k // wide for k in blocks], "r": [r] * len(blocks),
                     "a": [a[k:k + wide].tobytes() for k in blocks], "b": [b[k:k + wide].tobytes() for k in blocks]})


_SECOND = "s bigint, length bigint, v bigint, j bigint, y binary"


def _across(group: pa.Table) -> pa.Table:
    """A block of places of all classes: finishes the transforms, multiplies them, and goes the first half back."""
    group = group.sort_by("r")
    s, length, j = (group.column(c)[0].as_py() for c in ("s", "length", "j"))
    classes, each, wide, high = _shape(length)
    a, b = (np.fft.fft(np.frombuffer(b"".join(group.column(c).to_pylist()), dtype=np.complex128).reshape(classes, wide), axis=0) for c in ("a", "b"))
    place = j * wide + np.arange(wide)
    y = np.fft.ifft(a * b, axis=0) * np.exp(2j * np.pi * np.outer(np.arange(classes), place) / (classes * each))
    parts = range(0, classes, high)
    return pa.table({"s": [s] * len(parts), "length": [length] * len(parts), "v": [k // high for k in parts], "j": [j] * len(parts),
                     "y": [y[k:k + high].tobytes() for k in parts]})


def _frequencies(group: pa.Table) -> pa.Table:
    """A block of the convolution's residue classes: the way back is finished, the chirp taken off."""
    group = group.sort_by("j")
    s, length, v = (group.column(c)[0].as_py() for c in ("s", "length", "v"))
    classes, each, wide, high = _shape(length)
    y = np.concatenate([np.frombuffer(b, dtype=np.complex128).reshape(high, wide) for b in group.column("y").to_pylist()], axis=1)
    f = (v * high + np.arange(high))[:, None] + classes * np.arange(each)[None, :]
    kept = f <= length // 2
    f, x = f[kept], np.fft.ifft(y, axis=1)[kept]
    x = x * chirp(f, length)
    return pa.table({"s": np.full(len(f), s), "length": np.full(len(f), length), "f": f, "re": x.real.copy(), "im": x.imag.copy()})


@F.pandas_udf(_COEFFICIENTS)
def _short_spectrum(xs: pd.Series) -> pd.DataFrame:
    out = [np.fft.rfft(np.asarray(x, dtype=np.float64)) for x in xs]
    return pd.DataFrame({"re": [y.real for y in out], "im": [y.imag for y in out]})


def _spectrum(at: DataFrame, n: int, segment_rows: int) -> DataFrame:
    """(s, length, f, re, im) with ``X_f = sum_t x_t exp(-2 pi i f t / length)``, f from 0 to length // 2."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda z: z["x"])
    short = at.where(F.col("length") <= segment_rows).groupBy("s", "length").agg(values.alias("xs"))
    pairs = F.arrays_zip(F.col("y.re").alias("re"), F.col("y.im").alias("im"))
    short = short.withColumn("y", _short_spectrum("xs")).select("s", "length", F.posexplode(pairs).alias("f", "z"))
    short = short.select("s", "length", F.col("f").cast("bigint").alias("f"), "z.re", "z.im")
    if n <= segment_rows:
        return short
    bits = F.length(F.bin(2 * F.col("length") - 2))
    classes = F.pow(F.lit(2.0), F.floor(bits / 2)).cast("bigint")
    long = at.where(F.col("length") > segment_rows).withColumn("r", F.pmod("t", classes))
    first = long.select("s", "length", "t", "x", "r").groupBy("s", "r").applyInArrow(_class_transforms, _FIRST)
    second = first.groupBy("s", "j").applyInArrow(_across, _SECOND)
    return short.unionByName(second.groupBy("s", "v").applyInArrow(_frequencies, _SPECTRUM))


def spectrum_rows(df: DataFrame, value: str | Column, order_by: Sequence[str], partition_by: Sequence[str] = (), segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(series, length, f, re, im): the discrete Fourier transform of each series, f from 0 to length // 2."""
    at, keys, n = _positions(df, value, order_by, partition_by)
    return _named(_spectrum(at, n, segment_rows), keys, partition_by, "length", "f", "re", "im")


def _strongest(spectrum: DataFrame, k: int) -> DataFrame:
    """The ``k`` strongest harmonics of each series (0 < f < length / 2), ties by the lower frequency."""
    amplitude = F.hypot("re", "im")
    order = Window.partitionBy("s").orderBy(F.desc("amplitude"), "f")
    return (spectrum.where("f > 0 and 2 * f < length").withColumn("amplitude", amplitude)
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, k)))


def top_frequencies_rows(df: DataFrame, value: str | Column, k: int, order_by: Sequence[str], partition_by: Sequence[str] = (),
                         segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(series, rank, freq, amplitude, phase) of the ``k`` strongest harmonics of each series."""
    at, keys, n = _positions(df, value, order_by, partition_by)
    best = _strongest(_spectrum(at, n, segment_rows), k)
    return _named(best, keys, partition_by, "rank", (F.col("f") / F.col("length")).alias("freq"), "amplitude", F.atan2("im", "re").alias("phase"))


def _waves(t: Column, harmonics: Column, length: Column) -> Column:
    """``sum of re * cos(2 pi f t / length) - im * sin(...)``; f * t is reduced by whole turns."""
    def wave(acc: Column, h: Column) -> Column:
        turn = 2 * math.pi * F.pmod(h["f"] * t, length) / length
        return acc + h["re"] * F.cos(turn) - h["im"] * F.sin(turn)

    return F.aggregate(harmonics, F.lit(0.0), wave)


def _modes_of(spectrum: DataFrame) -> DataFrame:
    """(s, modes): the given rows of a spectrum as one short array a series."""
    return spectrum.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("f", "re", "im"))).alias("modes"))


def fourier_extrapolate_rows(df: DataFrame, value: str | Column, k: int, pred_len: int, order_by: Sequence[str], partition_by: Sequence[str] = (),
                             segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(series, t, seasonal): the ``k`` strongest harmonics at every row's place, from 0, and ``pred_len``
    steps beyond; zero for a series without harmonics."""
    at, keys, n = _positions(df, value, order_by, partition_by)
    modes = _modes_of(_strongest(_spectrum(at, n, segment_rows), k))
    ahead = at.where("t = 0").select("s", "length", F.explode(F.sequence(F.lit(0), F.lit(pred_len - 1))).alias("h")).select(
        "s", (F.col("length") + F.col("h")).alias("t"), "length") if pred_len > 0 else at.limit(0)
    places = at.select("s", "t", "length").unionByName(ahead.select("s", "t", "length"))
    joined = join_group_stats(places, modes, ["s"], how="left")
    seasonal = F.coalesce(2 * _waves(F.col("t"), F.col("modes"), F.col("length")) / F.col("length"), F.lit(0.0))
    return _named(joined.select("s", "t", seasonal.alias("seasonal")), keys, partition_by, "t", "seasonal")


def lowpass_rows(df: DataFrame, value: str | Column, modes: int, order_by: Sequence[str], partition_by: Sequence[str] = (), mode_select: str = "lowest",
                 seed: int = 0, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(series, t, smooth): each series from ``min(modes, length // 2)`` of its Fourier modes, the lowest
    (the mean included) or a seeded choice. Every row takes a sum over the modes."""
    at, keys, n = _positions(df, value, order_by, partition_by)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def kept(lengths: pd.Series) -> pd.Series:
        return lengths.map(lambda v: kept_modes(int(v), modes, mode_select, seed).astype(np.int64))

    chosen = at.where("t = 0").select(F.col("s").alias("_s"), F.explode(kept("length")).alias("_f"))
    spectrum = _spectrum(at, n, segment_rows)
    spectrum = spectrum.join(chosen, (F.col("s") == F.col("_s")) & (F.col("f") == F.col("_f"))).withColumns(
        {c: F.when(F.col("f") == 0, F.col(c)).otherwise(2 * F.col(c)) for c in ("re", "im")})
    joined = join_group_stats(at.select("s", "t", "length"), _modes_of(spectrum), ["s"], how="left")
    smooth = F.coalesce(_waves(F.col("t"), F.col("modes"), F.col("length")) / F.col("length"), F.lit(0.0))
    return _named(joined.select("s", "t", smooth.alias("smooth")), keys, partition_by, "t", "smooth")


# ----------------------------------------------------------------------- lags

def _lag_sums(max_lag: int):
    def run(group: pa.Table) -> pa.Table:
        """The products of each segment in the group with what follows up to ``max_lag`` rows later."""
        group = group.sort_by([("s", "ascending"), ("seg", "ascending"), ("u", "ascending")])
        s, seg, u, length, inside, x = (group.column(c).to_numpy() for c in ("s", "seg", "u", "length", "inside", "x"))
        cuts = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (seg[1:] != seg[:-1]), True])
        found: list[tuple[np.ndarray, ...]] = []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = int(inside[lo:hi].sum())
            if own:
                lags = min(max_lag, int(length[lo]) - 1)
                left, right = x[lo:lo + own], np.zeros(own + lags)
                right[:min(hi - lo, own + lags)] = x[lo:lo + own + lags][:hi - lo]
                if own * (lags + 1) > 1 << 16:
                    size = 1 << (own + lags - 1 + own).bit_length()
                    sums = np.fft.irfft(np.fft.rfft(right, size) * np.fft.rfft(left, size).conj(), size)[:lags + 1]
                else:
                    sums = np.correlate(right, left, "valid")
                found.append((np.full(lags + 1, s[lo]), np.full(lags + 1, length[lo]), np.arange(lags + 1), sums))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, dtype=np.int64)] * 3 + [np.zeros(0)]
        return pa.table({"s": cols[0], "length": cols[1], "lag": cols[2], "part": cols[3]})

    return run


def _correlations(at: DataFrame, n: int, max_lag: int, segment_rows: int | None) -> DataFrame:
    """(s, length, lag, corr) with ``corr = sum_t x_t * x_{(t + lag) mod length}``, lags up to ``max_lag``."""
    size = max(segment_rows or auto_bucket_rows(at.sparkSession, n), max_lag, 1)
    u, length = F.col("u"), F.col("length")
    # the beginning follows the end
    turned = at.where(F.col("t") < max_lag).withColumn("u", F.col("t") + length)
    spread = at.withColumn("u", F.col("t")).unionByName(turned)
    segments = F.sequence(F.floor(F.greatest(u - max_lag, F.lit(0)) / size), F.least(F.floor(u / size), F.floor((length - 1) / size)))
    rows = spread.withColumn("seg", F.explode(segments)).withColumn("inside", (u < length) & (F.floor(u / size) == F.col("seg")))
    tasks = _tasks(at, n, size)
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("s", "seg"), F.lit(tasks))).select("g", "s", "seg", "u", "length", "inside", "x")
    parts = dealt.groupBy("g").applyInArrow(_lag_sums(max_lag), "s bigint, length bigint, lag bigint, part double")
    return parts.groupBy("s", "length", "lag").agg(F.sum("part").alias("corr"))


def autocorrelation_rows(df: DataFrame, value: str | Column, max_lag: int, order_by: Sequence[str], partition_by: Sequence[str] = (),
                         segment_rows: int | None = None) -> DataFrame:
    """(series, lag, corr): circular autocorrelation of each series for lags from 0 to ``max_lag``, below its length."""
    at, keys, n = _positions(df, value, order_by, partition_by)
    return _named(_correlations(at, n, max_lag, segment_rows), keys, partition_by, "lag", "corr")


def _best_lags(corr: DataFrame, factor: float) -> DataFrame:
    """(s, lag, weight) of the ``int(factor * ln length)`` strongest lags (at least one), softmax weights."""
    order, series = Window.partitionBy("s").orderBy(F.desc("corr"), "lag"), Window.partitionBy("s")
    k = F.greatest(F.lit(1), F.floor(factor * F.log(F.col("length").cast("double"))).cast("int"))
    best = corr.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    weight = F.exp(F.col("corr") - F.max("corr").over(series))
    return best.withColumn("e", weight).select("s", "rank", "lag", (F.col("e") / F.sum("e").over(series)).alias("weight"))


def top_lags_rows(df: DataFrame, value: str | Column, factor: float, max_lag: int, order_by: Sequence[str], partition_by: Sequence[str] = (),
                  segment_rows: int | None = None) -> DataFrame:
    """(series, rank, lag, weight): each series' strongest lags among those up to ``max_lag``."""
    at, keys, n = _positions(df, value, order_by, partition_by)
    return _named(_best_lags(_correlations(at, n, max_lag, segment_rows), factor), keys, partition_by, "rank", "lag", "weight")


def time_delay_aggregate_rows(df: DataFrame, value: str | Column, factor: float, max_lag: int, order_by: Sequence[str], partition_by: Sequence[str] = (),
                              segment_rows: int | None = None) -> DataFrame:
    """(series, t, delayed): the series turned back by each of its strongest lags, added up by weight."""
    at, keys, n = _positions(df, value, order_by, partition_by)
    lags = _best_lags(_correlations(at, n, max_lag, segment_rows), factor).groupBy("s").agg(F.collect_list(F.struct("lag", "weight")).alias("lags"))
    joined = join_group_stats(at, lags, ["s"])
    moved = joined.select("s", "t", "length", "x", F.explode("lags").alias("w"))
    target = F.pmod(F.col("t") - F.col("w.lag"), F.col("length")).alias("t")
    out = moved.select("s", target, (F.col("w.weight") * F.col("x")).alias("v")).groupBy("s", "t").agg(F.sum("v").alias("delayed"))
    return _named(out, keys, partition_by, "t", "delayed")
