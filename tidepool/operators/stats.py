"""Table statistics that stay distributed at any size.

Exact quantiles use linear interpolation between order statistics (the same definition as
pandas ``quantile``, Spark ``percentile`` and DuckDB ``quantile_cont``). Two strategies:

* ``"sort"`` (default) — the order statistics needed, found by counting values in ever finer
  intervals. Nothing is sorted and no value is shuffled, so it works for a single global group of any
  size and any skew. Each pass serves all columns.
* ``"agg"`` — Spark's ``percentile`` aggregate. Keeps a value→count map per group; fine for small or
  low-cardinality inputs, not for a 10^12-row global group.
* ``"approx"`` — ``percentile_approx`` (opt-in, not equal to the exact definition).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.columns import stack_columns


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    method: str = "sort") -> dict[str, list[float | None]]:
    """``{column: [q(p) for p in probs]}`` over non-null values; ``None`` for an all-null column."""
    columns = list(columns)
    if not columns:
        return {}
    if method == "agg":
        row = df.agg(*[F.percentile(F.col(c).cast("double"), list(probs)).alias(c) for c in columns]).first()
        return {c: (list(row[c]) if row[c] is not None else [None] * len(probs)) for c in columns}
    if method == "approx":
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), list(probs), 100000).alias(c)
                       for c in columns]).first()
        return {c: (list(row[c]) if row[c] is not None else [None] * len(probs)) for c in columns}

    long = stack_columns(df.select(*columns), columns, "column", "value").where(F.col("value").isNotNull())
    return _order_statistics(long, columns, probs)


GRID_CELLS, LAST_VALUES = 512, 4096


def _cell(v: Column, lo: Column, hi: Column) -> Column:
    """The value's cell of an equal grid over lo..hi; never decreasing in the value, which is all that
    the search needs. Halved first, so that the widest range does not overflow."""
    step = (hi / 2 - lo / 2) / GRID_CELLS
    inside = F.floor(F.least((v / 2 - lo / 2) / step, F.lit(GRID_CELLS - 1.0))).cast("int")
    return (F.when(F.isnan(v), GRID_CELLS + 1).when(v == float("inf"), GRID_CELLS).when(v == float("-inf"), -1)
            .when(step > 0, inside).otherwise(0))


def _order_statistics(long: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of (column, value) rows by counting.

    Each pass counts the values that are still in question per cell of a grid, keeps the cells that
    hold a wanted rank and goes on with those, until one value or few values are left in a cell. No
    value is shuffled or sorted, only counts are; the driver sees at most GRID_CELLS rows for each
    open interval and LAST_VALUES values.
    """
    finite = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    spans = {r["column"]: r for r in long.groupBy("column").agg(F.count("*").alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi")).collect()}
    ranks: dict[str, set[int]] = {}
    for c, r in spans.items():
        for p in probs:
            at = p * (r["n"] - 1)
            ranks.setdefault(c, set()).update((math.floor(at), math.ceil(at)))
    found: dict[tuple[str, int], float] = {}
    # open intervals: (column, lo, hi, rank of the first value in it)
    opened = [(c, r["lo"], r["hi"], 0) for c, r in spans.items()]
    first = True
    while opened:
        table = long.sparkSession.createDataFrame(
            [(c, i, 0.0 if lo is None else lo, 0.0 if hi is None else hi) for i, (c, lo, hi, _) in enumerate(opened)],
            "o_column string, o_id int, o_lo double, o_hi double")
        here = F.col("column") == F.col("o_column")
        if not first:  # the first pass is over all values, also those that are not finite
            here = here & (F.col("value") >= F.col("o_lo")) & (F.col("value") <= F.col("o_hi")) & ~F.isnan("value")
        inside = long.join(F.broadcast(table), here)
        cells = (inside.groupBy("o_id", _cell(F.col("value"), F.col("o_lo"), F.col("o_hi")).alias("cell"))
                 .agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).orderBy("o_id", "cell").collect())
        following, last = [], []
        at = {i: o[3] for i, o in enumerate(opened)}
        for r in cells:
            c, before = opened[r["o_id"]][0], at[r["o_id"]]
            at[r["o_id"]] = before + r["n"]
            wanted = [k for k in ranks[c] if before <= k < before + r["n"] and (c, k) not in found]
            if not wanted:
                continue
            if r["lo"] == r["hi"] or math.isnan(r["lo"]):
                found.update({(c, k): r["lo"] for k in wanted})
            elif r["n"] <= LAST_VALUES // max(1, len(opened) * len(probs)):
                last.append((c, r["lo"], r["hi"], before))
            else:
                following.append((c, r["lo"], r["hi"], before))
        if last:
            table = long.sparkSession.createDataFrame([(i, *x[:3]) for i, x in enumerate(last)], "o_id int, o_column string, o_lo double, o_hi double")
            here = (F.col("column") == F.col("o_column")) & F.col("value").between(F.col("o_lo"), F.col("o_hi")) & ~F.isnan("value")
            values: dict[int, list[float]] = {}
            for r in long.join(F.broadcast(table), here).select("o_id", "value").collect():
                values.setdefault(r["o_id"], []).append(r["value"])
            for i, (c, _, _, before) in enumerate(last):
                ordered = sorted(values[i])
                found.update({(c, k): ordered[k - before] for k in ranks[c] if before <= k < before + len(ordered) and (c, k) not in found})
        opened, first = following, False
    out = {}
    for c in columns:
        if c not in spans:
            out[c] = [None] * len(probs)
            continue
        out[c] = []
        for p in probs:
            at = p * (spans[c]["n"] - 1)
            lo, hi = found[c, math.floor(at)], found[c, math.ceil(at)]
            out[c].append(lo + (hi - lo) * (at - math.floor(at)) if at != math.floor(at) else lo)
    return out


def mode_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: most frequent non-null value, ties broken by the smallest value.

    ``(column, value, freq, unique, count)`` — computed by a partial-aggregated group-by over
    (column, value) and a ``min(struct(-freq, value))`` per column, so no single task needs to hold
    a column's distinct values.
    """
    long = stack_columns(df.select(*columns), list(columns), "column", "value", cast="string")
    freq = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("freq"))
    best = freq.groupBy("column").agg(
        F.min(F.struct((-F.col("freq")).alias("neg"), F.col("value").alias("value"))).alias("best"),
        F.count(F.lit(1)).alias("unique"),
        F.sum("freq").alias("count"),
    )
    return best.select(
        "column",
        F.col("best.value").alias("value"),
        (-F.col("best.neg")).alias("freq"),
        "unique",
        "count",
    )
