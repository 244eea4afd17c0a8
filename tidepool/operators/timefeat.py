"""Time features (#50-#54): parsing, granularity, calendar encodings, chronological order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.columns import is_string_type
from tidepool.operators.stats import exact_quantiles
from tidepool.plans.order import ROW_INDEX, auto_bucket_rows, halo_frames, with_row_index

# Unambiguous formats, tried first, and those in which day and month can change places.
ISO_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
]
MONTH_FIRST_FORMATS = [f"MM{s}dd{s}yyyy{t}" for s in "/-" for t in (" HH:mm:ss", " HH:mm", "")]
DAY_FIRST_FORMATS = [f"dd{s}MM{s}yyyy{t}" for s in "/-" for t in (" HH:mm:ss", " HH:mm", "")]
# Granularity → encodings it selects.
GRANULARITY_FEATURES = {
    "year": ["year"],
    "month": ["year", "month"],
    "day": ["year", "month", "day", "weekday"],
    "hour": ["year", "month", "day", "weekday", "hour"],
    "minute": ["year", "month", "day", "weekday", "hour", "minute"],
}
# Median-gap thresholds in seconds (28 days, 1 day, 1 hour).
MONTH_GAP_S = 28 * 86400
DAY_GAP_S = 86400
HOUR_GAP_S = 3600


def parse_time(c: str | Column, formats: Sequence[str] | None = None, day_first: bool = False) -> Column:
    """Timestamp from a string or timestamp column; unparsable → null (safe under ANSI mode).

    01/02/2020 is 2 January, or 1 February with ``day_first``; a date that only the other order allows
    is read in that order.
    """
    x = F.col(c) if isinstance(c, str) else c
    swapped = [DAY_FIRST_FORMATS, MONTH_FIRST_FORMATS] if day_first else [MONTH_FIRST_FORMATS, DAY_FIRST_FORMATS]
    fmts = list(formats) if formats else [*ISO_FORMATS, *swapped[0], *swapped[1]]
    s = x.cast("string")
    attempts = [F.try_to_timestamp(s, F.lit(f)) for f in fmts]
    return F.coalesce(*attempts, F.try_to_timestamp(s)).cast("timestamp_ntz")


def time_column(df: DataFrame, name: str, day_first: bool = False) -> Column:
    """The column itself when it already holds timestamps or dates, else parsed from text."""
    from pyspark.sql import types as T

    dt = df.schema[name].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(name).cast("timestamp_ntz")
    return parse_time(name, day_first=day_first)


def epoch_seconds(c: str | Column) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(x.cast("timestamp")) / F.lit(1_000_000.0)


def median_gap_seconds(df: DataFrame, time_col: str, quantile_method: str = "sort") -> float | None:
    """Median gap between consecutive sorted timestamps (None when fewer than 2 rows)."""
    t = df.select(epoch_seconds(time_col).alias("_t")).where(F.col("_t").isNotNull())
    indexed, n = with_row_index(t, ["_t"], index_col=ROW_INDEX)
    return median_gap_indexed(indexed, F.col("_t"), n, ROW_INDEX, quantile_method)


def median_gap_indexed(indexed: DataFrame, seconds: Column, n: int, index_col: str = ROW_INDEX,
                       quantile_method: str = "sort") -> float | None:
    """Median gap over a frame already indexed in time order (no second sort)."""
    if n < 2:
        return None
    pairs = halo_frames(indexed, 2, {"ts": seconds}, index_col,
                        bucket_rows=auto_bucket_rows(indexed.sparkSession, n, 2), n_rows=n)
    gaps = pairs.select((F.element_at("ts", 2) - F.element_at("ts", 1)).alias("gap"))
    return exact_quantiles(gaps, ["gap"], [0.5], method=quantile_method)["gap"][0]


def granularity_indexed(indexed: DataFrame, seconds: Column, n: int, index_col: str = ROW_INDEX) -> str:
    """The granularity of a frame already indexed in time order, from one pass: for each threshold, whether
    the median gap reaches it follows from how many gaps lie below it and from its neighbours."""
    if n < 2:
        return granularity_from_gap(None)
    pairs = halo_frames(indexed, 2, {"ts": seconds}, index_col, bucket_rows=auto_bucket_rows(indexed.sparkSession, n, 2), n_rows=n)
    gap = F.element_at("ts", 2) - F.element_at("ts", 1)
    limits = (HOUR_GAP_S, DAY_GAP_S, MONTH_GAP_S)
    found = pairs.select(gap.alias("gap")).agg(F.count("gap").alias("n"), *[
        F.struct(F.count_if(F.col("gap") < v).alias("below"), F.max(F.when(F.col("gap") < v, F.col("gap"))).alias("under"),
                 F.min(F.when(F.col("gap") >= v, F.col("gap"))).alias("over")).alias(f"t{v}") for v in limits]).first()
    reached = None
    for v in limits:
        r, lower, upper = found[f"t{v}"], (found["n"] - 1) // 2, found["n"] // 2
        if found["n"] and (r["below"] <= lower or (r["below"] == upper and (r["under"] + r["over"]) / 2 >= v)):
            reached = v
    return granularity_from_gap(reached if reached is not None else 0 if found["n"] else None)


def granularity_from_gap(gap: float | None) -> str:
    if gap is None:
        return "hour"
    if gap >= MONTH_GAP_S:
        return "month"
    if gap >= DAY_GAP_S:
        return "day"
    if gap >= HOUR_GAP_S:
        return "hour"
    return "minute"


def infer_granularity(df: DataFrame, time_col: str) -> str:
    t = df.select(epoch_seconds(time_col).alias("_t")).where(F.col("_t").isNotNull())
    indexed, n = with_row_index(t, ["_t"], index_col=ROW_INDEX)
    return granularity_indexed(indexed, F.col("_t"), n)


def encoding_columns(ts: Column) -> dict[str, Column]:
    """Scaled calendar encodings (weekday Monday = 0)."""
    # Origin and divisors of the scaled encodings.
    return {
        "year": (F.year(ts) - 2000) / F.lit(100.0),
        "month": F.month(ts) / F.lit(12.0),
        "day": F.dayofmonth(ts) / F.lit(31.0),
        "weekday": F.weekday(ts) / F.lit(7.0),
        "hour": F.hour(ts) / F.lit(23.0),
        "minute": F.minute(ts) / F.lit(59.0),
    }


def time_encoding(df: DataFrame, time_col: str, granularity: str = "auto") -> tuple[DataFrame, list[str], str]:
    """Add the encodings chosen by ``granularity`` (``auto`` = inferred from the median gap).

    A column already named like an encoding suppresses it. A missing time column, or text that is not
    a time in any row, gives no encoding and granularity ``auto``. On a stream the granularity must be
    given, and text that is not a time has null encodings, as no row can be looked at beforehand.
    """
    if time_col not in df.columns:
        return df, [], "auto"
    ts = time_column(df, time_col)
    if df.isStreaming:
        if granularity == "auto":
            raise ValueError("a stream has no median gap: give the granularity")
    elif is_string_type(df.schema[time_col].dataType) and not df.where(F.col(time_col).isNotNull() & ts.isNull()).isEmpty():
        return df, [], "auto"
    if granularity == "auto":
        granularity = infer_granularity(df.select(ts.alias("_ts")), "_ts")
    selected = GRANULARITY_FEATURES.get(granularity, GRANULARITY_FEATURES["hour"])
    enc = encoding_columns(ts)
    names = [n for n in selected if n not in df.columns]
    return df.select("*", *[enc[n].alias(n) for n in names]), names, granularity


def calendar_marks(df: DataFrame, time_col: str, freq: str = "h", day_first: bool = True) -> DataFrame:
    """Raw integer marks: month, day, weekday, hour and, for minute data (``t``), minute // 15."""
    ts = time_column(df, time_col, day_first=day_first)
    cols = [F.month(ts).alias("month"), F.dayofmonth(ts).alias("day"), F.weekday(ts).alias("weekday"),
            F.hour(ts).alias("hour")]
    if freq in ("t", "min", "15min"):
        cols.append(F.floor(F.minute(ts) / 15).cast("int").alias("minute"))
    return df.select("*", *cols)


def sort_chronologically(df: DataFrame, time_col: str, tie_breaker: Sequence[str],
                         index_col: str = ROW_INDEX) -> tuple[DataFrame, int]:
    """Order by parsed time (+ unique tie-breaker) and attach the new 0-based row index."""
    staged = df.withColumn("_tp_t", time_column(df, time_col))
    indexed, n = with_row_index(staged, ["_tp_t", *tie_breaker], index_col=index_col)
    return indexed.drop("_tp_t"), n
