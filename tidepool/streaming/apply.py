"""Fit on batch, apply on stream.

The row-local operators — column drops, constant/zero fills, NaN handling, applying fitted scalers,
target unscaling, time parsing and calendar encodings, label encoding with a fitted dictionary,
MLlib model scoring — need no order and no table statistics once fitted, so the same functions
run unchanged on a streaming DataFrame. ``prepare_rows`` chains them; ``stream_to_table`` runs a
stream to a sink with a checkpoint in the session's checkpoint directory.

``distinct_stream`` is the one operator with state: the rows seen within the watermark.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidepool.operators import clean, scale, timefeat
from tidepool.operators.features import LabelDictionary, label_encode
from tidepool.session import ensure_checkpoint_dir


def prepare_rows(
    df: DataFrame,
    drop: Sequence[str] = (),
    zero_fill: Sequence[str] = (),
    scaler: scale.ScalerParams | None = None,
    time_col: str | None = None,
    granularity: str | None = None,
    dictionaries: Sequence[LabelDictionary] = (),
) -> DataFrame:
    """Row-local preparation with parameters fitted beforehand on a batch table."""
    out = df
    if drop:
        out, _ = clean.drop_columns(out, list(drop))
    if zero_fill:
        out = clean.fill_zero(out, list(zero_fill))
    if scaler is not None:
        out = scale.apply_scaler(out, scaler)
    if time_col is not None and granularity is not None:
        out, _, _ = timefeat.time_encoding(out, time_col, granularity)
    for d in dictionaries:
        out = label_encode(out, d)
    return out


def distinct_stream(df: DataFrame, time_col: str, delay: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A stream's rows without repetitions (#24): of rows that agree in ``columns`` (default: all) and whose
    times lie within ``delay`` of each other, the first to arrive.

    Keys stay in the state store until the watermark, the latest time less ``delay``, has passed them, so
    the state is bounded by the rows of that span. Nulls compare equal. A row later than the watermark is
    dropped, as its key may be gone. Restarted from its checkpoint, the stream goes on with its state.
    """
    keys = list(columns) if columns is not None else list(df.columns)
    return df.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def file_stream(spark, path: str, schema, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def stream_to_table(df: DataFrame, name: str, fmt: str = "memory", path: str | None = None,
                    checkpoint: str | None = None, available_now: bool = True):
    """Start the stream (append mode). Checkpoints go under the session's checkpoint directory."""
    base = ensure_checkpoint_dir(df.sparkSession)
    ck = checkpoint or os.path.join(base, f"stream-{name}")
    w = df.writeStream.outputMode("append").option("checkpointLocation", ck)
    if available_now:
        w = w.trigger(availableNow=True)
    if fmt == "memory":
        return w.format("memory").queryName(name).start()
    return w.format(fmt).option("path", path).start()
