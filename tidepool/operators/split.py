"""Splitting (#60-#67). All splits are index ranges over an explicit order.

Random order is ``md5(concat_ws(':', key, seed))`` (then the key), which is exact-size,
reproducible and identical across engines; ``randomSplit`` is neither exact nor reproducible
across partitionings.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.plans.order import ROW_INDEX, with_row_index

# Month and day counts of the fixed benchmark borders (12/4/4 months of 30 days).
FIXED_BORDER_MONTHS = (12, 4, 4)
DAYS_PER_MONTH = 30
STEPS_PER_HOUR = {"hourly": 1, "15min": 4}


def md5_order(keys: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


FIRST_DIGITS, MORE_DIGITS, LAST_ROWS = 3, 4, 4096


class Cut(NamedTuple):
    """A place in the random order: after ``skip`` of the rows with this hash and these keys."""

    hash: str
    keys: tuple
    skip: int


def _in_order(values: Sequence) -> tuple:
    """A key that sorts values as Spark does: nulls first, NaN above all numbers."""
    return tuple((v is not None, isinstance(v, float) and v != v, 0 if v is None or v != v else bytes(v) if isinstance(v, bytearray) else v) for v in values)


def random_cuts(df: DataFrame, keys: Sequence[str], seed: int, ranks_of: Callable[[int], Sequence[int]]) -> tuple[int, list[Cut | None]]:
    """The row count n and, for each rank in ``ranks_of(n)``, the cut before the row with that rank in
    the random order; None for a rank of n or more.

    Rows are counted by a prefix of their hash, the prefix that holds a rank is refined, and the few
    keys that are left are sorted on the driver. Nothing but counts is shuffled.
    """
    named = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    rows = df.select(md5_order(keys, seed).alias("h"), *named)
    prefix = F.substring("h", 1, FIRST_DIGITS)
    counts = {r["p"]: r["n"] for r in rows.groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    ranks = list(ranks_of(n))
    cuts: dict[int, Cut] = {}
    groups = {"": (0, counts)}  # prefix → rank of its first row, counts of the longer prefixes
    while groups:
        open_, last = {}, {}
        for before, held in groups.values():
            for p in sorted(held):
                if any(before <= r < before + held[p] for r in ranks if r not in cuts):
                    (last if held[p] <= LAST_ROWS or len(p) >= 32 else open_)[p] = before
                before += held[p]
        if last:
            size = {len(p) for p in last}
            here = F.lit(False)
            for k in size:
                here = here | F.substring("h", 1, k).isin([p for p in last if len(p) == k])
            found = sorted((tuple(r) for r in rows.where(here).groupBy(*rows.columns).agg(F.count("*").alias("n")).collect()), key=lambda r: _in_order(r[:-1]))
            for p, at in last.items():
                for r in (r for r in found if r[0].startswith(p)):
                    cuts.update({k: Cut(r[0], r[1:-1], k - at) for k in ranks if at <= k < at + r[-1]})
                    at += r[-1]
        groups = {}
        if open_:
            k = len(next(iter(open_)))
            longer = rows.where(F.substring("h", 1, k).isin(list(open_))).groupBy(F.substring("h", 1, k + MORE_DIGITS).alias("p")).agg(F.count("*").alias("n"))
            for r in longer.collect():
                p = r["p"][:k]
                groups.setdefault(p, (open_[p], {}))[1][r["p"]] = r["n"]
    return n, [cuts.get(r) for r in ranks]


def _key_is(df: DataFrame, keys: Sequence[str], seed: int, cut: Cut) -> Column:
    out = md5_order(keys, seed) == cut.hash
    for k, v in zip(keys, cut.keys):
        out = out & F.col(k).eqNullSafe(F.lit(v).cast(df.schema[k].dataType))
    return out


def _not_before(df: DataFrame, keys: Sequence[str], seed: int, cut: Cut) -> Column:
    """Whether a row's (hash, keys) is that of the cut or comes after it."""
    out = F.lit(True)
    for k, v in reversed(list(zip(keys, cut.keys))):
        v = F.lit(v).cast(df.schema[k].dataType)
        out = F.coalesce(F.col(k) > v, F.col(k).isNotNull() & v.isNull()) | (F.col(k).eqNullSafe(v) & out)
    h = md5_order(keys, seed)
    return (h > cut.hash) | ((h == cut.hash) & out)


def with_part(df: DataFrame, keys: Sequence[str], seed: int, cuts: Sequence[Cut | None], out_col: str) -> DataFrame:
    """Add the number of cuts at or before each row: a comparison with literals, without a shuffle.

    Only rows that share their keys with a cut inside their tie (keys that do not identify a row) are
    told apart by an index over themselves; equal ones among them can stand for each other.
    """
    real = [c for c in cuts if c is not None]
    part = sum((_not_before(df, keys, seed, c).cast("int") for c in real), F.lit(0))
    ties = {(c.hash, c.keys): c for c in real if c.skip}
    if not ties:
        return df.withColumn(out_col, part)
    tied = functools.reduce(lambda a, b: a | b, (_key_is(df, keys, seed, c) for c in ties.values()))
    rest = df.where(~tied).withColumn(out_col, part)
    own = df.where(tied).withColumns({"_tp_h": md5_order(keys, seed), "_tp_row": F.xxhash64(*df.columns)})
    indexed, _ = with_row_index(own, ["_tp_h", *keys, "_tp_row"], index_col="_tp_at")
    counts = {(r[0], tuple(r[1:-1])): r[-1] for r in own.groupBy("_tp_h", *keys).count().collect()}
    start, less = 0, F.lit(0)
    for key in sorted(counts, key=lambda k: _in_order((k[0], *k[1]))):
        for c in real:
            if c.skip and (c.hash, c.keys) == key:
                less = less + F.when(_key_is(df, keys, seed, c) & (F.col("_tp_at") < start + c.skip), 1).otherwise(0)
        start += counts[key]
    return rest.unionByName(indexed.withColumn(out_col, part - less).drop("_tp_h", "_tp_row", "_tp_at"))


def test_count(n: int, test_size: float) -> int:
    """Rows on the test side of a random split (a fraction rounds up, an integer is a count)."""
    if isinstance(test_size, int) and test_size >= 1:
        return test_size
    return math.ceil(n * test_size)


def random_split(df: DataFrame, keys: Sequence[str], test_size: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test): filters on the rows' hash, without a shuffle."""
    sides = random_split_labels(df, keys, test_size, seed, "_tp_side")
    return sides.where("_tp_side = 'train'").drop("_tp_side"), sides.where("_tp_side = 'test'").drop("_tp_side")


def random_split_labels(df: DataFrame, keys: Sequence[str], test_size: float = 0.2, seed: int = 42,
                        out_col: str = "side") -> DataFrame:
    _, cuts = random_cuts(df, keys, seed, lambda n: [test_count(n, test_size)])
    part = with_part(df, keys, seed, cuts, "_tp_part")
    return part.withColumn(out_col, F.when(F.col("_tp_part") == 0, "test").otherwise("train")).drop("_tp_part")


def chronological_cut(n: int, test_size: float) -> int:
    """``int(n * (1 - test_size))`` evaluated in binary floating point, as the reference does."""
    return int(n * (1 - test_size))


def chronological_split(
    indexed: DataFrame,
    n: int,
    test_size: float = 0.2,
    index_col: str = ROW_INDEX,
    min_train: int = 0,
) -> tuple[DataFrame, DataFrame, int]:
    """Prefix/suffix split of an indexed frame; raises when the train side is below ``min_train``."""
    cut = chronological_cut(n, test_size)
    if cut < min_train:
        raise ValueError(f"{cut} training rows are fewer than the {min_train} that one window needs")
    train = indexed.where(F.col(index_col) < cut)
    test = indexed.where(F.col(index_col) >= cut).withColumn(index_col, F.col(index_col) - cut)
    return train, test, cut


def border_ranges(n: int, seq_len: int, ratios: tuple[float, float, float] = (0.7, 0.1, 0.2)) -> dict[str, tuple[int, int]]:
    """[start, end) of train/val/test; val and test start ``seq_len`` rows early."""
    num_train = int(n * ratios[0])
    num_test = int(n * ratios[2])
    num_val = n - num_train - num_test
    return {
        "train": (0, num_train),
        "val": (num_train - seq_len, num_train + num_val),
        "test": (n - num_test - seq_len, n),
    }


def fixed_border_ranges(kind: str, seq_len: int) -> dict[str, tuple[int, int]]:
    steps = 24 * DAYS_PER_MONTH * STEPS_PER_HOUR[kind]
    a, b, c = (m * steps for m in FIXED_BORDER_MONTHS)
    return {"train": (0, a), "val": (a - seq_len, a + b), "test": (a + b - seq_len, a + b + c)}


def split_by_ranges(indexed: DataFrame, ranges: dict[str, tuple[int, int]], index_col: str = ROW_INDEX,
                    side_col: str = "side", local_col: str = "side_idx") -> DataFrame:
    """One output row per (row, side it belongs to); rows in an overlap appear on two sides."""
    i = F.col(index_col)
    sides = F.array(*[
        F.when((i >= F.lit(lo)) & (i < F.lit(hi)), F.struct(F.lit(name).alias("s"), (i - F.lit(lo)).alias("p")))
        for name, (lo, hi) in ranges.items()
    ])
    return (indexed.withColumn("_tp_side", F.explode(F.filter(sides, lambda x: x.isNotNull())))
            .withColumn(side_col, F.col("_tp_side.s")).withColumn(local_col, F.col("_tp_side.p"))
            .drop("_tp_side"))


def border_split(indexed: DataFrame, n: int, seq_len: int, ratios=(0.7, 0.1, 0.2), index_col: str = ROW_INDEX) -> DataFrame:
    return split_by_ranges(indexed, border_ranges(n, seq_len, ratios), index_col)


def fixed_border_split(indexed: DataFrame, kind: str, seq_len: int, index_col: str = ROW_INDEX) -> DataFrame:
    return split_by_ranges(indexed, fixed_border_ranges(kind, seq_len), index_col)


def tail_holdout(indexed: DataFrame, n: int, keep: float = 0.8, index_col: str = ROW_INDEX) -> DataFrame:
    """Validation = rows from ``int(n * keep)`` on (the tail of train)."""
    start = int(n * keep)
    return indexed.where(F.col(index_col) >= start).withColumn(index_col, F.col(index_col) - start)


def fold_starts(n: int, k: int) -> list[int]:
    """Rank of the first row of folds 1..k-1: the first ``n % k`` folds hold one row more."""
    q, r = divmod(n, k)
    return [f * q + min(f, r) for f in range(1, k)]


def kfold(df: DataFrame, keys: Sequence[str], k: int = 5, seed: int = 42, fold_col: str = "fold") -> DataFrame:
    """Shuffled k-fold assignment by k - 1 cuts of the random order."""
    if k < 2:
        raise ValueError("k must be >= 2")
    n, cuts = random_cuts(df, keys, seed, lambda n: fold_starts(n, k))
    if n < k:
        raise ValueError(f"{k} folds need at least as many rows, the table has {n}")
    return with_part(df, keys, seed, cuts, fold_col).withColumn(fold_col, F.col(fold_col).cast("int"))


def fold_holdout(folded: DataFrame, fold: int, keys: Sequence[str], test_size: float = 0.2, seed: int = 42,
                 fold_col: str = "fold") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, val, test) for one fold: the training folds are split 80/20 again."""
    test = folded.where(F.col(fold_col) == fold)
    rest = folded.where(F.col(fold_col) != fold)
    train, val = random_split(rest, keys, test_size, seed)
    return train, val, test


def limit_series(df: DataFrame, series_col: str, limit: float) -> DataFrame:
    """First ``limit`` series by id, or that fraction of them when ``limit <= 1``; a null id is no series.

    The ids are in order, so the choice is a comparison with the last chosen id: no join.
    """
    ids = df.select(series_col).where(F.col(series_col).isNotNull()).distinct()
    if limit <= 1:
        limit = limit * ids.count()
    if int(limit) < 1:
        return df.where(F.lit(False))
    idx, n = with_row_index(ids, [series_col], index_col="_tp_sid")
    if int(limit) >= n:
        return df.where(F.col(series_col).isNotNull())
    last = idx.where(F.col("_tp_sid") == int(limit) - 1).first()[series_col]
    return df.where(F.col(series_col) <= F.lit(last).cast(df.schema[series_col].dataType))
