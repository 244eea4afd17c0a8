"""Cleaning and imputation (#24-#38).

Fills that need a statistic compute all of them in one aggregation pass and apply them as
literals; order-dependent fills (ffill/bfill/interpolate) use the bucketed carry of
``plans.order`` so a long (or hot) series never lands in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.columns import FLOAT64_MAX, is_numeric_type, is_string_type, known_numbers, nan_to_null
from tidepool.operators.stats import exact_quantiles, mode_table
from tidepool.plans.order import (
    auto_bucket_rows,
    fill_ordered,
    with_row_index,
    with_series_position,
)
from tidepool.session import cut_lineage

# Fill value for an all-null string column.
UNKNOWN_LABEL = "Unknown"


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Full-row distinct (nulls compare equal, as in the reference)."""
    return df.dropDuplicates()


def duplicate_report(df: DataFrame) -> DataFrame:
    """(rows_before, rows_after, removed) from one grouped pass."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.sum("_c").alias("rows_before"), F.count(F.lit(1)).alias("rows_after")).select(
        "rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("removed")
    )


class CleanNote(NamedTuple):
    """One thing a cleaning step did or left undone: which column, by which rule, how many rows or nulls."""

    column: str | None
    rule: str
    count: int


def drop_columns(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[CleanNote]]:
    """Without the named columns. Names that the table lacks are ignored, and a request for all
    columns leaves the last one named, as a table needs one."""
    asked = list(dict.fromkeys(c for c in columns if c in df.columns))
    spared = asked[-1:] if asked and set(asked) == set(df.columns) else []
    gone = [c for c in asked if c not in spared]
    notes = [CleanNote(c, "dropped", 1) for c in gone] + [CleanNote(c, "kept_last_column", 1) for c in spared]
    return df.drop(*gone), notes


def iqr_filter(
    df: DataFrame,
    factor: float = 1.5,
    columns: Sequence[str] | None = None,
    quantile_method: str = "sort",
    checkpoint_every: int = 4,
) -> tuple[DataFrame, list[CleanNote]]:
    """Tukey's fences column by column, each with the quartiles of the rows that are still there.

    A column does not filter if three rows or fewer are left, if its quartiles coincide, or if its
    fences would remove nothing or everything. A null lies outside any fence. Quartiles are searched
    for several columns in the same passes; when rows go, for the next column alone, then for twice as
    many at a time, so that no more than three searches a column are made. The table's lineage is cut
    after every ``checkpoint_every`` columns that filtered. The notes count the rows removed by
    column (rule ``outside_fences``) and name the columns that met too few rows (``too_few_rows``).
    """
    names = list(columns) if columns is not None else [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]
    notes: list[CleanNote] = []
    start = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(f"m{i}")
                                                   for i, c in enumerate(names)]).first()
    left, n, missing = df, start["n"], {c: start[f"m{i}"] for i, c in enumerate(names)}
    known: dict[str, list] = {}
    block = len(names)
    for k, c in enumerate(names):
        if n <= 3:
            notes.append(CleanNote(c, "too_few_rows", n))
            continue
        if c not in known:
            known, block = exact_quantiles(left, names[k:k + block], [0.0, 0.25, 0.75, 1.0], method=quantile_method), 2 * block
        least, low, high, most = known[c]
        if low is None or low == high:
            continue
        reach = factor * (high - low)
        if not missing[c] and low - reach <= least and most <= high + reach:
            continue
        inside = F.coalesce(F.col(c).between(F.lit(low - reach), F.lit(high + reach)), F.lit(False))
        outside = left.where(~inside).count()
        if outside in (0, n):
            continue
        left, n = left.where(inside), n - outside
        known, block = {}, 1
        notes.append(CleanNote(c, "outside_fences", outside))
        filtered = sum(x.rule == "outside_fences" for x in notes)
        if checkpoint_every and filtered % checkpoint_every == 0:
            left = cut_lineage(left)
    return left, notes


# ---------------------------------------------------------------- imputation by statistic

def _column_stats(df: DataFrame, num: Sequence[str], strategy: str, quantile_method: str) -> dict[str, object]:
    if not num:
        return {}
    if strategy == "median":
        q = exact_quantiles(df, num, [0.5], method=quantile_method)
        return {c: q[c][0] for c in num}
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in num]).first()
    return {c: row[c] for c in num}


def _modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    if not cols:
        return {}
    found = {r["column"]: r["value"] for r in mode_table(df, cols).collect()}
    return {c: found.get(c, UNKNOWN_LABEL) for c in cols}


def _fill_literal(c: str, dtype, value) -> Column:
    from pyspark.sql import types as T

    known = nan_to_null(c) if isinstance(dtype, (T.DoubleType, T.FloatType)) else F.col(c)
    if value is None:
        return known.alias(c)
    if isinstance(dtype, T.NumericType):
        value = _number(c, value)
    if isinstance(dtype, T.IntegralType) and isinstance(value, float) and not float(value).is_integer():
        # a fractional statistic turns an integer column into a float one (as pandas does)
        return F.coalesce(F.col(c).cast("double"), F.lit(value)).alias(c)
    return F.coalesce(known, F.lit(value).cast(dtype)).alias(c)


def _number(c: str, value) -> int | float:
    """A fill value for a numeric column; a number may be given as text, as a form sends it."""
    if isinstance(value, str):
        try:
            value = float(value.strip())
        except ValueError:
            raise ValueError(f"{value!r} is no number to fill column {c} with") from None
        value = int(value) if value.is_integer() else value
    return value


def fill_missing(
    df: DataFrame,
    strategy: str = "auto",
    columns: Sequence[str] | None = None,
    fill_value=None,
    order_by: Sequence[str | Column] | None = None,
    partition_by: Sequence[str] = (),
    quantile_method: str = "sort",
    bucket_rows: int | None = None,
) -> DataFrame:
    """Dispatcher with the reference's fall-throughs.

    numeric: ``auto``/``mean``/``mode``/unknown → mean, ``median``, ``zero``, ``constant`` (mean when no
    value), ``ffill``/``bfill`` (need ``order_by``). string: ``constant`` with a value → that value,
    anything else → mode (ties → smallest; all-null → ``Unknown``). Columns of other types are
    left alone; an unknown column name raises. NaN is a missing number like null, and a constant for a
    numeric column may be given as text.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(columns) if columns is not None else list(df.columns)
    for c in cols:
        if c not in types:
            raise KeyError(c)
    num = [c for c in cols if is_numeric_type(types[c])]
    cat = [c for c in cols if is_string_type(types[c])]

    df = known_numbers(df, num)
    num_values: dict[str, object] = {}
    ordered: list[str] = []
    if strategy in ("ffill", "bfill"):
        ordered = num
    elif strategy == "zero":
        num_values = {c: 0 for c in num}
    elif strategy == "constant" and fill_value is not None:
        num_values = {c: fill_value for c in num}
    elif strategy == "median":
        num_values = _column_stats(df, num, "median", quantile_method)
    else:
        num_values = _column_stats(df, num, "mean", quantile_method)

    if strategy == "constant" and fill_value is not None:
        cat_values = {c: str(fill_value) for c in cat}
    else:
        cat_values = _modes(df, cat)

    out = df.select(*[
        _fill_literal(c, types[c], num_values.get(c)) if c in num_values
        else _fill_literal(c, types[c], cat_values.get(c)) if c in cat_values
        else F.col(c)
        for c in df.columns
    ])
    if ordered:
        if not order_by:
            raise ValueError("ffill/bfill need an explicit order_by")
        out = fill_forward(out, ordered, order_by, partition_by, backward=(strategy == "bfill"),
                           bucket_rows=bucket_rows)
    return out


def fill_report(before: DataFrame, after: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, nulls_before, nulls_after, filled) of a fill, from one pass over either table."""
    names = list(columns) if columns is not None else list(before.columns)
    count = lambda df, tag: known_numbers(df, names).agg(*[F.count_if(F.col(c).isNull()).alias(f"{tag}{i}") for i, c in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"b{i}").alias("nulls_before"), F.col(f"a{i}").alias("nulls_after"),
                              (F.col(f"b{i}") - F.col(f"a{i}")).alias("filled")) for i, c in enumerate(names)])
    one = F.lit(1).alias("one")  # two tables of one row each
    return count(before, "b").select("*", one).join(count(after, "a").select("*", one), "one").select(F.inline(rows))


def fill_mean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return fill_missing(df, "mean", columns)


def fill_median(df: DataFrame, columns: Sequence[str] | None = None, quantile_method: str = "sort") -> DataFrame:
    return fill_missing(df, "median", columns, quantile_method=quantile_method)


def fill_zero(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric nulls → 0 (row-local: also runs on a stream)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(columns) if columns is not None else list(df.columns)
    num = [c for c in cols if is_numeric_type(types[c])]
    return df.select(*[_fill_literal(c, types[c], 0) if c in num else F.col(c) for c in df.columns])


def fill_constant(df: DataFrame, value, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls → ``value`` in numeric and string columns (row-local: also runs on a stream). A text that is no
    number raises for a numeric column that is named; without names it fills the string columns only."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = set(columns) if columns is not None else set(df.columns)
    exprs = []
    for c in df.columns:
        if c in cols and is_numeric_type(types[c]):
            try:
                exprs.append(_fill_literal(c, types[c], value))
            except ValueError:
                if columns is not None:
                    raise
                exprs.append(F.col(c))
        elif c in cols and is_string_type(types[c]):
            exprs.append(_fill_literal(c, types[c], str(value)))
        else:
            exprs.append(F.col(c))
    return df.select(*exprs)


def fill_mode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """String nulls → most frequent value (ties → smallest; all-null column → ``Unknown``)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(columns) if columns is not None else list(df.columns)
    cat = [c for c in cols if is_string_type(types[c])]
    vals = _modes(df, cat)
    return df.select(*[_fill_literal(c, types[c], vals[c]) if c in vals else F.col(c) for c in df.columns])


def fill_forward(
    df: DataFrame,
    columns: Sequence[str],
    order_by: Sequence[str | Column],
    partition_by: Sequence[str] = (),
    backward: bool = False,
    bucket_rows: int | None = None,
) -> DataFrame:
    """Last (next) non-null value along ``order_by`` within optional series.

    Leading nulls stay for a forward fill, trailing nulls for a backward fill.
    """
    indexed, n = with_row_index(df, [*partition_by, *order_by], index_col="_tp_fill_idx")
    bucket_rows = bucket_rows or auto_bucket_rows(df.sparkSession, n)
    filled = fill_ordered(indexed, columns, "_tp_fill_idx", partition_by, backward, bucket_rows, n_rows=n)
    return filled.drop("_tp_fill_idx")


def fill_backward(df: DataFrame, columns: Sequence[str], order_by: Sequence[str | Column],
                  partition_by: Sequence[str] = (), bucket_rows: int | None = None) -> DataFrame:
    return fill_forward(df, columns, order_by, partition_by, True, bucket_rows)


def nan_to_zero(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN and null → 0, ±Inf → ±largest finite double (numpy ``nan_to_num``)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = set(columns) if columns is not None else {c for c in df.columns if is_numeric_type(types[c])}
    exprs = []
    for c in df.columns:
        if c in cols:
            x = F.col(c).cast("double")
            exprs.append(
                F.when(x.isNull() | F.isnan(x), F.lit(0.0))
                .when(x == F.lit(float("inf")), F.lit(FLOAT64_MAX))
                .when(x == F.lit(float("-inf")), F.lit(-FLOAT64_MAX))
                .otherwise(x).alias(c)
            )
        else:
            exprs.append(F.col(c))
    return df.select(*exprs)


def nonfinite_to_null_all(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN/±Inf → null in float columns (the output boundary rule)."""
    from pyspark.sql import types as T

    types = {f.name: f.dataType for f in df.schema.fields}
    cols = set(columns) if columns is not None else set(df.columns)
    exprs = []
    for c in df.columns:
        if c in cols and isinstance(types[c], (T.DoubleType, T.FloatType)):
            x = F.col(c)
            exprs.append(F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)
                         .cast(types[c]).alias(c))
        else:
            exprs.append(F.col(c))
    return df.select(*exprs)


def interpolate_linear(
    df: DataFrame,
    columns: Sequence[str],
    order_by: Sequence[str | Column],
    partition_by: Sequence[str] = (),
    bucket_rows: int | None = None,
) -> DataFrame:
    """Linear interpolation by position inside each series, both directions.

    Interior gaps: ``v0 + (v1-v0)*(i-i0)/(i1-i0)`` between the neighbouring non-null values; leading
    nulls take the first value, trailing nulls the last one. All-null series stay null.
    """
    idx = "_tp_interp_idx"
    indexed, n = with_row_index(df, [*partition_by, *order_by], index_col=idx)
    bucket_rows = bucket_rows or auto_bucket_rows(df.sparkSession, n)
    prev_cols, next_cols = [], []
    staged = indexed
    for c in columns:
        tag = F.when(F.col(c).isNotNull(), F.struct(F.col(idx).alias("i"), F.col(c).cast("double").alias("v")))
        staged = staged.withColumn(f"_tp_p_{c}", tag).withColumn(f"_tp_n_{c}", tag)
        prev_cols.append(f"_tp_p_{c}")
        next_cols.append(f"_tp_n_{c}")
    # previous and next non-null (index, value) in one bucketed pass
    staged = fill_ordered(staged, prev_cols, idx, partition_by, False, bucket_rows, backward_columns=next_cols, n_rows=n)
    out = []
    for c in indexed.columns:
        if c == idx:
            continue
        if c in columns:
            p, n = F.col(f"_tp_p_{c}"), F.col(f"_tp_n_{c}")
            i = F.col(idx)
            interp = p["v"] + (n["v"] - p["v"]) * (i - p["i"]) / F.when(n["i"] == p["i"], 1).otherwise(n["i"] - p["i"])
            out.append(
                F.when(F.col(c).isNotNull(), F.col(c).cast("double"))
                .when(p.isNull(), n["v"])
                .when(n.isNull(), p["v"])
                .otherwise(interp).alias(c)
            )
        else:
            out.append(F.col(c))
    return staged.select(*out)


def subsample(
    df: DataFrame,
    order_by: Sequence[str | Column],
    partition_by: Sequence[str],
    limit: int = 256,
    factor: int = 2,
    apply: bool = True,
) -> DataFrame:
    """Series longer than ``limit`` keep every ``factor``-th row (positions 0, f, 2f, ...)."""
    if not apply:
        return df
    idx = "_tp_sub_idx"
    indexed, n = with_row_index(df, [*partition_by, *order_by], index_col=idx)
    pos = with_series_position(indexed, partition_by, idx, "_tp_pos", length_col="_tp_len",
                               bucket_rows=auto_bucket_rows(df.sparkSession, n))
    keep = (F.col("_tp_len") <= limit) | (F.col("_tp_pos") % factor == 0)
    return pos.where(keep).select(*df.columns)


def ragged_dimensions(lengths: DataFrame, sample_col: str = "sample_id") -> bool:
    """True when any sample has dimensions of different lengths (triggers subsampling)."""
    r = lengths.groupBy(sample_col).agg(F.countDistinct("length").alias("k")).agg(F.max("k")).first()[0]
    return bool(r and r > 1)


def with_null_every(df: DataFrame, column: str, key: str, every: int, out: str | None = None) -> DataFrame:
    """Derive a column with nulls at ``key % every == 0`` (test fixtures for the fill operators)."""
    return df.withColumn(out or column, F.when(F.col(key) % every == 0, F.lit(None)).otherwise(F.col(column)))


__all__ = [
    "drop_columns", "drop_duplicates", "duplicate_report", "fill_backward", "fill_constant", "fill_forward",
    "fill_mean", "fill_median", "fill_missing", "fill_mode", "fill_zero", "interpolate_linear", "iqr_filter",
    "nan_to_zero", "nonfinite_to_null_all", "ragged_dimensions", "subsample", "with_null_every",
]
