"""Profiling and exploration (#16-#23): shape, schema, nulls, describe, preview, histogram, correlation.

Every statistic is one aggregation pass over the table (or one sort for exact quantiles); the
results are small long-form DataFrames.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions.columns import is_numeric_type, known_numbers, nonfinite_to_null, numeric_columns, stack_columns, string_columns
from tidepool.operators.stats import exact_quantiles, mode_table

# the pair sums run in Python workers: ship this module's code by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# describe's metric order for numeric columns.
DESCRIBE_NUMERIC_METRICS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
# describe's metric order for categorical columns.
DESCRIBE_CATEGORICAL_METRICS = ["count", "unique", "top", "freq"]


def pandas_dtype(dt: T.DataType) -> str:
    """The dtype name the reference reports for a column of this Spark type."""
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float64"
    if isinstance(dt, T.IntegralType):
        return "int64"
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime64[ns]"
    return "object"


def profile_shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_cols); an empty table reports zeros for both."""
    n_cols = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.when(F.col("n_rows") == 0, F.lit(0)).otherwise(F.lit(n_cols)).alias("n_cols")
    )


def profile_schema(df: DataFrame) -> DataFrame:
    """(position, column, dtype, non_null) — one aggregation for all columns."""
    fields = df.schema.fields
    counts = df.agg(*[F.count(F.col(f.name)).alias(f"c{i}") for i, f in enumerate(fields)])
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                 F.lit(pandas_dtype(f.dataType)).alias("dtype"), F.col(f"c{i}").alias("non_null"))
        for i, f in enumerate(fields)
    ])
    return counts.select(F.inline(rows))


def profile_nulls(df: DataFrame) -> DataFrame:
    """(column, null_count, null_pct) with the percentage rounded to 2 places (0 for an empty table). NaN
    counts as a null."""
    cols = df.columns
    df = known_numbers(df, cols)
    agg = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)],
    )
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("null_count")) for i, c in enumerate(cols)
    ])
    return agg.select("_n", F.inline(rows)).select(
        "column", "null_count",
        F.coalesce(F.round(F.try_divide("null_count", "_n") * 100, 2), F.lit(0.0)).alias("null_pct"),
    )


def columns_with_nulls(df: DataFrame) -> DataFrame:
    """Number of columns holding at least one null (the UI's summary figure)."""
    return profile_nulls(df).agg(F.count_if(F.col("null_count") > 0).alias("columns_with_nulls"))


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None, quantile_method: str = "sort") -> DataFrame:
    """(column, count, mean, std, min, p25, p50, p75, max) per numeric column; sample std. NaN is no value."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    if not cols:
        raise ValueError("no numeric columns")
    spark, df = df.sparkSession, known_numbers(df, cols)
    moments = df.agg(*[
        F.struct(F.count(c).alias("count"), F.avg(F.col(c).cast("double")).alias("mean"),
                 F.stddev_samp(F.col(c).cast("double")).alias("std"),
                 F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max")
                 ).alias(f"m{i}")
        for i, c in enumerate(cols)
    ])
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], method=quantile_method)
    qdf = spark.createDataFrame(
        [(c, *q[c]) for c in cols], "column string, p25 double, p50 double, p75 double"
    )
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}.count").alias("count"), F.col(f"m{i}.mean").alias("mean"),
                 F.col(f"m{i}.std").alias("std"), F.col(f"m{i}.min").alias("min"), F.col(f"m{i}.max").alias("max"))
        for i, c in enumerate(cols)
    ])
    long = moments.select(F.inline(rows))
    # qdf has one row per column: a bounded broadcast
    return long.join(F.broadcast(qdf), "column").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def describe_time(df: DataFrame, columns: Sequence[str] | None = None, quantile_method: str = "sort") -> DataFrame:
    """(column, count, mean_epoch_s, min, p25, p50, p75, max) per timestamp column (no std).

    Quantiles interpolate linearly on microseconds since the epoch; the mean is given in epoch
    seconds."""
    ts_types = (T.TimestampType, T.TimestampNTZType, T.DateType)
    cols = list(columns) if columns is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, ts_types)]
    if not cols:
        raise ValueError("no time columns")
    # wall-clock microseconds since the epoch (independent of the session time zone)
    micros = {c: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', "
                        f"cast(`{c}` as timestamp_ntz))") for c in cols}
    spark = df.sparkSession
    staged = df.select(*[micros[c].alias(c) for c in cols])
    q = exact_quantiles(staged, cols, [0.0, 0.25, 0.5, 0.75, 1.0], method=quantile_method)
    qdf = spark.createDataFrame([(c, *[None if v is None else int(round(v)) for v in q[c]]) for c in cols],
                                "column string, q0 long, q1 long, q2 long, q3 long, q4 long")
    moments = staged.agg(*[F.struct(F.count(c).alias("count"), (F.avg(c) / 1e6).alias("mean")).alias(f"m{i}")
                           for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}.count").alias("count"),
                              F.col(f"m{i}.mean").alias("mean_epoch_s")) for i, c in enumerate(cols)])
    long = moments.select(F.inline(rows))

    def ts(c: str):
        return F.expr(f"timestampadd(MICROSECOND, `{c}`, TIMESTAMP_NTZ'1970-01-01 00:00:00')")

    return long.join(F.broadcast(qdf), "column").select(
        "column", "count", "mean_epoch_s", ts("q0").alias("min"), ts("q1").alias("p25"), ts("q2").alias("p50"),
        ts("q3").alias("p75"), ts("q4").alias("max"))


def describe_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, count, unique, top, freq) per string column; ``top`` ties → smallest value."""
    cols = list(columns) if columns is not None else string_columns(df)
    if not cols:
        raise ValueError("no string columns")
    m = mode_table(df, cols)
    return m.select("column", "count", "unique", F.col("value").alias("top"), "freq")


def preview(df: DataFrame, n: int = 50, order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """First ``n`` rows in ``order_by`` (a top-k, planned as TakeOrderedAndProject)."""
    if order_by:
        return df.orderBy(*order_by).limit(n)
    return df.limit(n)


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 30) -> DataFrame:
    """Equal-width histogram per numeric column: (column, bin, lo, hi, count).

    Default columns: all numeric ones; non-numeric requests are ignored.
    Bins follow numpy: ``[e_k, e_{k+1})`` with the last bin closed; a constant column spans
    ``value ± 0.5``. All ``bins`` rows are present, zero counts included. NaN and infinite values have no
    bin and are left out.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    if columns is None:
        cols = numeric_columns(df)
    else:
        cols = [c for c in columns if c in types and is_numeric_type(types[c])]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, bin int, lo double, hi double, count bigint")
    long = stack_columns(df.select(*cols), cols, "column", "value").withColumn("value", nonfinite_to_null("value")).where(F.col("value").isNotNull())
    rng = long.groupBy("column").agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"))
    rng = rng.select(
        "column",
        F.when(F.col("vmin") == F.col("vmax"), F.col("vmin") - 0.5).otherwise(F.col("vmin")).alias("lo"),
        F.when(F.col("vmin") == F.col("vmax"), F.col("vmax") + 0.5).otherwise(F.col("vmax")).alias("hi"),
    )
    # one row per histogrammed column: bounded broadcast
    binned = long.join(F.broadcast(rng), "column").select(
        "column", bin_index(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin")
    )
    counts = binned.groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count"))
    spine = rng.select("column", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = spine.join(counts, ["column", "bin"], "left").select(
        "column", "bin",
        bin_edge(F.col("lo"), F.col("hi"), F.col("bin"), bins).alias("lo"),
        bin_edge(F.col("lo"), F.col("hi"), F.col("bin") + 1, bins).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0).cast("long")).alias("count"),
    )
    return out


def bin_edge(lo: Column, hi: Column, k: Column, bins: int) -> Column:
    """numpy ``linspace(lo, hi, bins+1)[k]``: ``lo + k*step``, the last edge exactly ``hi``."""
    return F.when(k == bins, hi).otherwise(lo + k * ((hi - lo) / F.lit(float(bins))))


def bin_index(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """numpy's bin search: scaled floor, then corrected against the actual edges."""
    raw = F.floor((v - lo) * (F.lit(float(bins)) / (hi - lo))).cast("int")
    k = F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))
    k = F.when((v < bin_edge(lo, hi, k, bins)) & (k > 0), k - 1).otherwise(k)
    k = F.when((v >= bin_edge(lo, hi, k + 1, bins)) & (k < bins - 1), k + 1).otherwise(k)
    return k


def _pair_sums(centre: list[float]):
    """Per task: for every pair of columns the number of rows that have both, and over those rows the
    sums of x, x² and x·y, as matrix products of whole batches."""

    def run(batches):
        k = len(centre)
        sums = np.zeros((4, k, k))
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(k)]).astype(np.float64) - centre
            there = (~np.isnan(x)).astype(np.float64)
            x = np.nan_to_num(x)
            sums += np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
        kind, i, j = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (kind, i, j, sums)], names=["kind", "i", "j", "v"])

    return run


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame | None:
    """Pearson correlation of all numeric pairs, long form (col_i, col_j, r), pairwise-complete.

    ``None`` when fewer than 2 numeric columns (the reference returns no figure). A pair without
    variance has a null. The columns are centred first, then one pass takes all pairs' sums; a task
    sends four matrices of C × C, whatever its rows.
    """
    cols = list(columns) if columns is not None else numeric_columns(df)
    if len(cols) < 2:
        return None
    x = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    means = x.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in cols]).first()
    cells = x.mapInArrow(_pair_sums([means[c] or 0.0 for c in cols]), "kind bigint, i bigint, j bigint, v double")
    sums = cells.groupBy("i", "j").pivot("kind", [0, 1, 2, 3]).agg(F.sum("v")).toDF("i", "j", "n", "sx", "sxx", "sxy")
    turned = sums.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("sx").alias("sy"), F.col("sxx").alias("syy"))
    both = sums.join(turned, ["i", "j"])
    var_x, var_y = F.col("n") * F.col("sxx") - F.col("sx") ** 2, F.col("n") * F.col("syy") - F.col("sy") ** 2
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    # sums of squares that cancel to rounding error have no variance
    spread = (var_x > 1e-12 * F.col("n") * F.col("sxx")) & (var_y > 1e-12 * F.col("n") * F.col("syy"))
    r = F.when(spread, F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(var_x * var_y)))))
    names = F.array(*[F.lit(c) for c in cols])
    return both.select(F.get(names, F.col("i").cast("int")).alias("col_i"), F.get(names, F.col("j").cast("int")).alias("col_j"), r.alias("r"))
