"""The end-to-end time-series path: table → calendar features → chronological split → scaling →
sliding windows → ridge forecast per horizon → metrics.

``prepare_time_series`` is the Spark form of the reference's small time-series pipeline: one lazy
plan per side with train-only statistics inlined as literals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators import evaluate, scale, series, split, timefeat, windows
from tidepool.operators.features import feature_columns, fit_label_encoder, infer_task, label_encode
from tidepool.operators.models import fit_ridge
from tidepool.plans.order import ROW_INDEX, with_row_index


@dataclass(frozen=True)
class SplitMeta:
    feature_names: tuple[str, ...]
    target_name: str
    task_type: str
    seq_len: int
    pred_len: int
    granularity: str
    encodings: tuple[str, ...]
    cut: int
    n_rows: int
    scaler: scale.ScalerParams
    target_scaler: scale.ScalerParams
    classes: tuple[str, ...] = ()
    n_classes: int = 1


def prepare_time_series(
    df: DataFrame,
    time_col: str,
    target: str,
    tie_breaker: list[str] | None = None,
    seq_len: int = 24,
    pred_len: int = 1,
    test_size: float = 0.2,
    normalization: str | None = "minmax",
    granularity: str = "auto",
) -> tuple[DataFrame, DataFrame, SplitMeta]:
    """Windows ``(window_id, x, y)`` for train and test plus the fitted metadata.

    A text target makes the task a classification: ``y`` holds the codes of its classes, which are in
    the metadata, and is not scaled.
    """
    windows.check_window_params(seq_len, pred_len)
    df, classes = _coded_target(df, target)
    staged = df.withColumn("_tp_t", timefeat.time_column(df, time_col))
    indexed, n = with_row_index(staged, ["_tp_t", *(tie_breaker or [])])
    if granularity == "auto":
        # the median gap comes from the chronological index built for the split (no second sort)
        granularity = timefeat.granularity_indexed(indexed, timefeat.epoch_seconds("_tp_t"), n)
    indexed, enc_names, gran = timefeat.time_encoding(indexed, time_col, granularity)
    num, _ = feature_columns(indexed, target, exclude=[time_col, "_tp_t", ROW_INDEX])
    train, test, cut = split.chronological_split(indexed, n, test_size, min_train=seq_len + pred_len)
    n_test = n - cut
    if n_test - seq_len - pred_len + 1 <= 0:
        raise ValueError(f"{n_test} test rows hold no window of {seq_len} + {pred_len} rows")

    # statistics of the flattened train windows, weighted by window coverage (no explode)
    if normalization in ("minmax", "mean"):
        fparams = scale.fit_scaler_windowed(train, num, cut, seq_len, pred_len, normalization)
    else:
        fparams = scale.ScalerParams(None, tuple(num))
    tparams = (scale.ScalerParams(None, (target,)) if classes
               else scale.fit_scaler_windowed(train, [target], cut, seq_len, pred_len, "mean", part="y"))

    def side(frame: DataFrame, rows: int) -> DataFrame:
        scaled = scale.apply_scaler(frame, fparams) if fparams.method else frame
        scaled = scale.scale_target(scaled, tparams, target)
        return windows.sliding_windows_indexed(scaled, seq_len, pred_len, num, target, ROW_INDEX, n=rows)

    meta = SplitMeta(tuple(num), target, "classification" if classes else "regression", seq_len, pred_len, gran, tuple(enc_names), cut, n,
                     fparams, tparams, classes, len(classes) or 1)
    return side(train, cut), side(test, n_test), meta


def _coded_target(df: DataFrame, target: str) -> tuple[DataFrame, tuple[str, ...]]:
    """A text target as class codes, with the classes in code order; another target as it is."""
    task, _ = infer_task(df, target)
    if task != "classification":
        return df, ()
    labels = fit_label_encoder(df, target)
    return label_encode(df, labels), tuple(r["label"] for r in labels.table.orderBy("code").collect())


def prepare_seq2seq(
    df: DataFrame,
    time_col: str,
    target: str,
    tie_breaker: list[str] | None = None,
    seq_len: int = 24,
    pred_len: int = 1,
    label_len: int = 12,
    test_size: float = 0.2,
    normalization: str | None = "minmax",
    granularity: str = "auto",
) -> tuple[DataFrame, DataFrame, SplitMeta]:
    """Encoder–decoder windows ``(window_id, x, x_mark, dec_inp, y_mark, y)`` for train and test.

    Values are the numeric columns with the target last, marks the calendar encodings. The scaler of
    the values is fitted on the training rows; a regression target in ``y`` follows it.
    """
    windows.check_window_params(seq_len, pred_len, label_len)
    df, classes = _coded_target(df, target)
    indexed, n = timefeat.sort_chronologically(df, time_col, tie_breaker or [])
    encoded, marks, gran = timefeat.time_encoding(indexed, time_col, granularity)
    num, _ = feature_columns(encoded, target, exclude=[time_col, ROW_INDEX, *marks])
    values = [*num, target]
    train, test, cut = split.chronological_split(encoded, n, test_size, min_train=seq_len + pred_len)
    method = scale.target_policy("large", normalization, "regression")
    scaled = num if classes else values
    params = scale.fit_scaler(train, scaled, method) if method and scaled else scale.ScalerParams(None, tuple(scaled))

    def side(frame: DataFrame, rows: int) -> DataFrame:
        return windows.seq2seq_windows_indexed(scale.apply_scaler(frame, params), seq_len, pred_len, label_len, values, marks, target,
                                               ROW_INDEX, n=rows)

    own = scale.ScalerParams(None, (target,)) if classes or not method else params.target(len(values) - 1)
    meta = SplitMeta(tuple(values), target, "classification" if classes else "regression", seq_len, pred_len, gran, tuple(marks), cut, n,
                     params, own, classes, len(classes) or 1)
    return side(train, cut), side(test, n - cut), meta


def decomposed_features(w: DataFrame, n_channels: int, kernel: int = 25) -> DataFrame:
    """Seasonal and trend parts of every channel of the ``x`` window, concatenated: the inputs of
    the decomposition-linear forecaster. (Seasonal + trend is linear in x, hence the ridge term.)"""
    k = kernel if kernel % 2 == 1 else kernel + 1

    def channel(j: int):
        return F.transform("x", lambda r: F.element_at(r, j + 1))

    chans = w.select("window_id", "y", *[channel(j).alias(f"_c{j}") for j in range(n_channels)])
    parts = chans.select("window_id", "y", *[series.decompose(f"_c{j}", k).alias(f"_d{j}") for j in range(n_channels)])
    feats = [F.concat(F.col(f"_d{j}.seasonal"), F.col(f"_d{j}.trend")) for j in range(n_channels)]
    return parts.select("window_id", F.concat(*feats).alias("features"), "y")


def ridge_forecast(train_w: DataFrame, test_w: DataFrame, pred_len: int, reg: float = 1e-3,
                   n_channels: int | None = None, kernel: int = 25) -> DataFrame:
    """Ridge regressions of all horizon steps from one pass over the training windows, and one
    projection of the test windows; returns (window_id, y, yhat).

    With ``n_channels`` the features are the per-channel seasonal/trend decomposition of the window
    (the reference's decomposition-linear model); without, the flattened window."""
    def flat(w: DataFrame) -> DataFrame:
        if n_channels:
            return decomposed_features(w, n_channels, kernel)
        return w.select("window_id", F.flatten("x").alias("features"), "y")

    model = fit_ridge(flat(train_w), "features", "y", reg)
    if model.weights.shape[0] != pred_len:
        raise ValueError(f"the windows have {model.weights.shape[0]} target steps, not {pred_len}")
    return flat(test_w).select("window_id", "y", model.predict("features").alias("yhat"))


def flagship_forecast(spark: SparkSession, sf_dir: str, seq_len: int = 24, pred_len: int = 1) -> DataFrame:
    """events → hourly series → calendar encodings → split → scale → windows → ridge → metrics row."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    hourly = ev.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t")).agg(
        F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
    train_w, test_w, meta = prepare_time_series(hourly, "t", "value", seq_len=seq_len, pred_len=pred_len)
    scored = ridge_forecast(train_w, test_w, pred_len, n_channels=len(meta.feature_names))
    m = evaluate.regression_metrics_multi(scored)
    return m.select(
        F.round("mse", 6).alias("mse"), F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"),
        F.round("r2", 6).alias("r2"), F.lit(meta.granularity).alias("granularity"),
        F.lit(meta.cut).alias("train_rows"), F.lit(meta.n_rows - meta.cut).alias("test_rows"),
    )
