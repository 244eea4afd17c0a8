"""Windowing (#68-#76).

Frames at every row come from ``plans.order.halo_frames``: a bucketed window over a dense row index, so a
window never needs the whole (or a whole hot) series in one task. A window is one row; a
multi-feature window is ``array<array<double>>`` (time × feature), built from one per-row array so
the frame collects a single column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.plans.order import ROW_INDEX, auto_bucket_rows, halo_frames, with_row_index, with_series_position


def _row_array(cols: Sequence[str | Column]) -> Column:
    return F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in cols])


def check_window_params(seq_len: int, pred_len: int, label_len: int = 0) -> None:
    """The reference's preconditions plus ``label_len <= seq_len``."""
    if seq_len < 2:
        raise ValueError("seq_len must be >= 2")
    if pred_len < 1:
        raise ValueError("pred_len must be >= 1")
    if label_len < 0:
        raise ValueError("label_len must be >= 0")
    if seq_len <= pred_len:
        raise ValueError("seq_len must be greater than pred_len")
    if label_len > seq_len:
        raise ValueError("label_len must not exceed seq_len")


def _require_windows(n: int | None, span: int, what: str = "windows") -> None:
    if n is not None and n - span + 1 <= 0:
        raise ValueError(f"{n} rows hold no {what} of {span} rows")


def sliding_windows_indexed(
    indexed: DataFrame,
    seq_len: int,
    pred_len: int,
    feature_cols: Sequence[str | Column],
    target_col: str | Column,
    index_col: str = ROW_INDEX,
    partition_by: Sequence[str] = (),
    n: int | None = None,
    bucket_rows: int | None = None,
) -> DataFrame:
    """Stride-1 windows over an indexed frame: ``x = rows [i, i+L)``, ``y = target [i+L, i+L+P)``.

    Output: ``window_id`` (index of the first row), series keys, ``x array<array<double>>``,
    ``y array<double>``.
    """
    span = seq_len + pred_len
    _require_windows(n, span)
    bucket_rows = bucket_rows or (auto_bucket_rows(indexed.sparkSession, n, span) if n else None)
    t = (F.col(target_col) if isinstance(target_col, str) else target_col).cast("double")
    frames = halo_frames(indexed, span, {"_rows": _row_array(feature_cols), "_t": t}, index_col, partition_by,
                         bucket_rows=bucket_rows, n_rows=n)
    return frames.select(
        F.col(index_col).alias("window_id"), *partition_by,
        F.slice("_rows", 1, seq_len).alias("x"),
        F.slice("_t", seq_len + 1, pred_len).alias("y"),
    )


def sliding_windows(
    df: DataFrame,
    seq_len: int,
    pred_len: int,
    order_by: Sequence[str | Column],
    feature_cols: Sequence[str | Column],
    target_col: str | Column,
    partition_by: Sequence[str] = (),
    bucket_rows: int | None = None,
) -> DataFrame:
    indexed, n = with_row_index(df, [*partition_by, *order_by])
    bucket_rows = bucket_rows or auto_bucket_rows(df.sparkSession, n, seq_len + pred_len)
    return sliding_windows_indexed(indexed, seq_len, pred_len, feature_cols, target_col, ROW_INDEX, partition_by,
                                   None if partition_by else n, bucket_rows)


def seq2seq_windows_indexed(
    indexed: DataFrame,
    seq_len: int,
    pred_len: int,
    label_len: int,
    value_cols: Sequence[str | Column],
    mark_cols: Sequence[str | Column],
    target_col: str | Column,
    index_col: str = ROW_INDEX,
    partition_by: Sequence[str] = (),
    n: int | None = None,
    bucket_rows: int | None = None,
) -> DataFrame:
    """Encoder–decoder bundle per window: ``x, x_mark, dec_inp, y_mark, y``.

    ``dec_inp`` = last ``label_len`` rows of ``x`` followed by ``pred_len`` zero rows; ``y_mark`` covers
    rows ``[i+L-label_len, i+L+P)``.
    """
    check_window_params(seq_len, pred_len, label_len)
    span = seq_len + pred_len
    _require_windows(n, span)
    bucket_rows = bucket_rows or (auto_bucket_rows(indexed.sparkSession, n, span) if n else None)
    width = len(value_cols)
    t = (F.col(target_col) if isinstance(target_col, str) else target_col).cast("double")
    frames = halo_frames(indexed, span, {"_v": _row_array(value_cols), "_m": _row_array(mark_cols), "_t": t},
                         index_col, partition_by, bucket_rows=bucket_rows, n_rows=n)
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), width), pred_len)
    known = F.slice("_v", seq_len - label_len + 1, label_len) if label_len > 0 else F.slice("_v", 1, 0)
    return frames.select(
        F.col(index_col).alias("window_id"), *partition_by,
        F.slice("_v", 1, seq_len).alias("x"),
        F.slice("_m", 1, seq_len).alias("x_mark"),
        F.concat(known, zeros).alias("dec_inp"),
        F.slice("_m", seq_len - label_len + 1, label_len + pred_len).alias("y_mark"),
        F.slice("_t", seq_len + 1, pred_len).alias("y"),
    )


def overlap_windows_indexed(
    indexed: DataFrame,
    seq_len: int,
    label_len: int,
    pred_len: int,
    value_cols: Sequence[str | Column],
    mark_cols: Sequence[str | Column],
    index_col: str = ROW_INDEX,
    partition_by: Sequence[str] = (),
    bucket_rows: int | None = None,
) -> DataFrame:
    """Loader windows: ``seq_x = rows [s, s+L)``, ``seq_y = rows [s+L-label_len, s+L+P)`` with their marks."""
    span = seq_len + pred_len
    frames = halo_frames(indexed, span, {"_v": _row_array(value_cols), "_m": _row_array(mark_cols)},
                         index_col, partition_by, bucket_rows=bucket_rows)
    return frames.select(
        F.col(index_col).alias("window_id"), *partition_by,
        F.slice("_v", 1, seq_len).alias("seq_x"),
        F.slice("_v", seq_len - label_len + 1, label_len + pred_len).alias("seq_y"),
        F.slice("_m", 1, seq_len).alias("seq_x_mark"),
        F.slice("_m", seq_len - label_len + 1, label_len + pred_len).alias("seq_y_mark"),
    )


def strided_windows_indexed(
    indexed: DataFrame,
    win: int,
    step: int,
    value_cols: Sequence[str | Column],
    label_col: str | Column | None = None,
    index_col: str = ROW_INDEX,
) -> DataFrame:
    """Windows of ``win`` rows starting at 0, step, 2·step, …: ``(n - win) // step + 1`` of them.

    A row goes to the windows that hold it, numbers ``ceil((i - win + 1) / step) .. floor(i / step)``,
    so the work is ``win / step`` copies of the rows, and no group has more than ``win`` rows.
    ``label_col`` carries per-row labels (test side); without it ``labels`` is null (train/val).
    """
    i = F.col(index_col)
    first = F.greatest(F.lit(0).cast("long"), F.ceil((i - (win - 1)) / step).cast("long"))
    last = F.floor(i / step).cast("long")
    item = F.struct(i.alias("i"), _row_array(value_cols).alias("r"),
                    *([(F.col(label_col) if isinstance(label_col, str) else label_col).cast("double").alias("l")] if label_col is not None else []))
    held = indexed.where(first <= last).select(F.explode(F.sequence(first, last)).alias("window_id"), item.alias("item"))
    g = held.groupBy("window_id").agg(F.array_sort(F.collect_list("item")).alias("_items")).where(F.size("_items") == win)
    labels = F.transform("_items", lambda s: s["l"]) if label_col is not None else F.lit(None).cast("array<double>")
    return g.select("window_id", F.transform("_items", lambda s: s["r"]).alias("x"), labels.alias("labels"))


def tiling_windows_indexed(
    indexed: DataFrame,
    win: int,
    value_cols: Sequence[str | Column],
    label_col: str | Column | None = None,
    index_col: str = ROW_INDEX,
) -> DataFrame:
    """Non-overlapping windows ``[k·win, (k+1)·win)``; an incomplete last one is dropped.

    Grouped by tile id: every group holds exactly ``win`` rows, so no group is unbounded.
    """
    item = F.struct(F.col(index_col).alias("i"), _row_array(value_cols).alias("r"),
                    *([(F.col(label_col) if isinstance(label_col, str) else label_col).cast("double").alias("l")]
                      if label_col is not None else []))
    g = indexed.groupBy(F.floor(F.col(index_col) / win).cast("long").alias("window_id")).agg(
        F.array_sort(F.collect_list(item)).alias("_items"))
    g = g.where(F.size("_items") == win)
    labels = F.transform("_items", lambda s: s["l"]) if label_col is not None else F.lit(None).cast("array<double>")
    return g.select("window_id", F.transform("_items", lambda s: s["r"]).alias("x"), labels.alias("labels"))


PAD_RUN = 1 << 16


def pad_series_long(
    df: DataFrame,
    series: Sequence[str],
    order_by: Sequence[str | Column],
    value_cols: Sequence[str],
    max_len: int | None = None,
) -> DataFrame:
    """Each series clipped or zero-padded to ``max_len`` rows (default: the longest): one row per
    position, (series, length, pos, values, mask). No series is collected, so any length will do."""
    df = df.select(*series, *[c for c in order_by if c not in series], *[c for c in value_cols if c not in series])
    indexed, n = with_row_index(df, [*series, *order_by])
    pos = with_series_position(indexed, series, ROW_INDEX, "pos", "_len", bucket_rows=auto_bucket_rows(df.sparkSession, n))
    if max_len is None:
        max_len = df.groupBy(*series).count().agg(F.max("count")).first()[0] or 0
    kept = pos.where(F.col("pos") < max_len).select(*series, F.least("_len", F.lit(max_len)).alias("length"), "pos",
                                                    *[F.col(c).cast("double").alias(c) for c in value_cols], F.lit(True).alias("mask"))
    lengths = df.groupBy(*series).agg(F.least(F.count(F.lit(1)), F.lit(max_len)).alias("length")).where(F.col("length") < max_len)
    # positions in runs, so that no row holds an array as long as a series
    runs = lengths.select("*", F.explode(F.sequence(F.col("length").cast("long"), F.lit(max_len - 1).cast("long"), F.lit(PAD_RUN).cast("long"))).alias("_run"))
    padding = runs.select(*series, "length", F.explode(F.sequence(F.col("_run"), F.least(F.col("_run") + (PAD_RUN - 1), F.lit(max_len - 1).cast("long")))).alias("pos"),
                             *[F.lit(0.0).alias(c) for c in value_cols], F.lit(False).alias("mask"))
    return kept.unionByName(padding)


def pad_series(
    df: DataFrame,
    series: Sequence[str],
    order_by: Sequence[str | Column],
    value_cols: Sequence[str],
    max_len: int,
) -> DataFrame:
    """The rows of ``pad_series_long`` as one array per series, with a mask: ``max_len`` bounds what a
    group collects, so it must be given. For series of any length use the long form."""
    long = pad_series_long(df, series, order_by, value_cols, max_len)
    g = long.groupBy(*series, "length").agg(
        F.array_sort(F.collect_list(F.struct("pos", _row_array(value_cols).alias("r"), "mask"))).alias("_it"))
    return g.select(*series, "length", F.transform("_it", lambda s: s["r"]).alias("x"), F.transform("_it", lambda s: s["mask"]).alias("mask"))


def last_window(
    df: DataFrame,
    series: Sequence[str],
    order_by: Sequence[str | Column],
    value_col: str | Column,
    seq_len: int,
) -> DataFrame:
    """Last ``seq_len`` values per series, left-padded with zeros, with a 0/1 mask."""
    df = df.select(*series, *[c for c in order_by if c not in series], value_col)
    indexed, n = with_row_index(df, [*series, *order_by])
    pos = with_series_position(indexed, series, ROW_INDEX, "_pos", length_col="_len",
                               bucket_rows=auto_bucket_rows(df.sparkSession, n))
    tail = pos.where(F.col("_pos") >= F.col("_len") - seq_len)
    v = (F.col(value_col) if isinstance(value_col, str) else value_col).cast("double")
    g = tail.groupBy(*series).agg(F.array_sort(F.collect_list(F.struct(F.col("_pos").alias("p"), v.alias("v"))))
                                  .alias("_it"))
    k = F.size("_it")
    pad = F.array_repeat(F.lit(0.0), F.lit(seq_len) - k)
    return g.select(
        *series,
        F.concat(pad, F.transform("_it", lambda s: s["v"])).alias("insample"),
        F.concat(pad, F.array_repeat(F.lit(1.0), k)).alias("mask"),
    )


def patch(x: str | Column, patch_len: int, stride: int, padding: int = 0) -> Column:
    """Cut a 1-D window into patches; the end is padded by replicating the last value."""
    a = F.col(x) if isinstance(x, str) else x
    padded = F.concat(a, F.array_repeat(F.element_at(a, -1), padding)) if padding > 0 else a
    n_patches = F.floor((F.size(padded) - patch_len) / stride).cast("int") + 1
    return F.transform(F.sequence(F.lit(0), n_patches - 1),
                       lambda k: F.slice(padded, k * stride + 1, patch_len))


def segment_padding(seq_len: int, seg_len: int) -> int:
    """Padding that makes ``seq_len`` a multiple of ``seg_len``."""
    return -(-seq_len // seg_len) * seg_len - seq_len


def multiscale_tails(x: str | Column, scales: Sequence[int], pred_len: int) -> Column:
    """``array`` of the last ``scale·pred_len`` steps of the window, one entry per scale."""
    a = F.col(x) if isinstance(x, str) else x
    return F.array(*[F.slice(a, -s * pred_len, s * pred_len) for s in scales])
