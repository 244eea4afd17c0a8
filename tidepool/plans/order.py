"""Scale-safe ordering primitives.

Row order is semantic for fills, splits and windows, but Spark rows have none. Everything here
works from an explicit total order and never moves the whole table into one task:

* ``with_row_index`` — a dense 0-based global index. Rows are counted, dealt to ranges of the order
  (``repartitionByRange``), sorted inside them and written once to the shared folder with their range
  and place. The index is ``offset[range] + place``; only the sizes of a bounded number of ranges ever
  reach the driver, more of them are summed up in a table. Nothing depends on a cache, and a lost
  executor costs a re-read.
* ``fill_ordered`` — forward/backward fill over the global (or per-series) order. A row index is
  cut into buckets of ``bucket_rows``; the window runs per bucket, and a small per-bucket "carry"
  table (last non-null value of each bucket, prefix-filled over buckets) supplies values that come
  from earlier buckets. One hot series only ever occupies whole buckets, so no task holds more
  than ``bucket_rows`` rows.
* ``halo_frames`` — sliding frames of ``span`` rows. Each row goes to its own bucket and, if it is
  among the first ``span-1`` rows of a bucket, also to the previous one (the halo). Windows start
  in the bucket that owns their first row, so the result equals the global frame.
* ``with_series_position`` — position of a row inside its series, from the global index and the
  series' first index (aggregate + join; AQE turns it into a broadcast when the aggregate is small
  and splits skewed partitions otherwise).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.session import default_partitions, scratch_folder

ROW_INDEX = "row_idx"
# Rows per bucket for bucketed windows. Large enough that the halo (span-1 rows) is negligible,
# small enough that a bucket always fits comfortably in one task's memory.
DEFAULT_BUCKET_ROWS = 1 << 20

_PID = "_tp_pid"


@dataclass(frozen=True)
class Desc:
    """A key in descending order, nulls last."""

    column: str


def _key(k: str | Column | Desc) -> tuple[Column, bool]:
    if isinstance(k, Desc):
        return F.col(k.column), True
    return (F.col(k) if isinstance(k, str) else k), False


def _sort_columns(order_by: Sequence[str | Column | Desc]) -> list[Column]:
    return [c.desc() if desc else c.asc() for c, desc in map(_key, order_by)]


# Target bytes per range of the order.
TARGET_PARTITION_BYTES = 256 << 20
# Up to this many ranges their offsets travel as a literal array in the plan; above it they are summed
# up by a job and joined on as a table.
MAX_LITERAL_OFFSETS = 4096
# Sums over ranges are taken in two steps, inside runs of so many ranges and over the runs.
RANGES_PER_RUN = 4096
# A table of offsets is broadcast up to so many rows (16 bytes each), counted before.
MAX_BROADCAST_OFFSETS = 1 << 22


def counted(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes), counted in one pass that reads only the columns of varying width."""
    varying = [F.octet_length(c) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else 8 * F.size(c)
               for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)) for c in [df[f"`{f.name}`"]]]
    sums = [F.sum(F.greatest(v, F.lit(0))) for v in varying]
    rows, *more = df.agg(F.count(F.lit(1)), *sums).first()
    return rows, 8 * rows * max(1, len(df.columns)) + sum(int(x or 0) for x in more)


def target_partitions(df: DataFrame, size: tuple[int, int] | None = None) -> int:
    """Range count: at least ``spark.sql.shuffle.partitions``, enough for about ``TARGET_PARTITION_BYTES``
    of counted data each, and never more than there are rows to fill them."""
    rows, n_bytes = size or counted(df)
    return max(default_partitions(df.sparkSession), min(rows, -(-n_bytes // TARGET_PARTITION_BYTES)))


_PLACE = "_tp_place"


def ordered_ranges(df: DataFrame, order_by: Sequence[str | Column | Desc], num_partitions: int | None = None) -> DataFrame:
    """The rows in ranges of the order, stored once: ``df`` with the number of the row's range (``_PID``)
    and its place inside (``_PLACE``).

    Range bounds are Spark's own, from a sample of the keys that does not grow beyond a million. As the
    rows are written with their places, these do not change in later executions.
    """
    keys = _sort_columns(order_by)
    n_parts = num_partitions or target_partitions(df)
    dealt = df.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys)
    # columns travel under plain names; one without a type is left out
    names = [f"c{i}" for i in range(len(df.columns))]
    held = [F.lit(None) if isinstance(f.dataType, T.NullType) else F.col(c) for c, f in zip(names, df.schema)]
    kept = [c for c, f in zip(names, df.schema) if not isinstance(f.dataType, T.NullType)]
    path = f"{scratch_folder(df.sparkSession)}/ranges"
    rows = dealt.toDF(*names).select(*kept, F.monotonically_increasing_id().alias("at"))
    rows.write.option("compression", "zstd").parquet(path)
    stored = df.sparkSession.read.schema(rows.schema).parquet(path)
    # the identifier holds the task in its upper bits and the row's place in the lower 33
    return stored.select(*[h.alias(c) for h, c in zip(held, df.columns)], F.shiftright("at", 33).alias(_PID),
                         F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias(_PLACE))


def _range_totals(ranged: DataFrame, sums: dict[str, Column]) -> tuple[DataFrame, list[tuple] | None]:
    """Totals of each range as a stored table, and as rows of the driver if there are few."""
    folder = scratch_folder(ranged.sparkSession)
    table = ranged.groupBy(_PID).agg(*[c.alias(name) for name, c in sums.items()])
    table.write.parquet(f"{folder}/totals")
    table = ranged.sparkSession.read.schema(table.schema).parquet(f"{folder}/totals")
    few = table.limit(MAX_LITERAL_OFFSETS + 1).collect()
    return table, None if len(few) > MAX_LITERAL_OFFSETS else sorted((tuple(r) for r in few), key=lambda r: r[0])


def _running_totals(totals: DataFrame, names: Sequence[str]) -> DataFrame:
    """Sums of all earlier ranges: within runs of ranges, plus the sums of all earlier runs."""
    run = F.floor(F.col(_PID) / RANGES_PER_RUN)
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = totals.groupBy(run.alias("run")).agg(*[F.sum(c).alias(c) for c in names])
    runs = runs.select("run", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"run_{c}") for c in names])
    inside = Window.partitionBy("run").orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    rows = totals.withColumn("run", run).join(runs, "run")
    return rows.select(F.col(_PID).alias("_tp_opid"), *[(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"run_{c}")).alias(f"_tp_off_{c}") for c in names])


def _with_offsets(ranged: DataFrame, sums: dict[str, Column]) -> tuple[DataFrame, dict[str, int | float]]:
    """``ranged`` with ``_tp_off_<name>``, the sum over all earlier ranges, and the sums over all rows."""
    table, few = _range_totals(ranged, sums)
    names = list(sums)
    if few is not None:
        out, ends = ranged, {}
        for i, name in enumerate(names, 1):
            at, running = [0] * (few[-1][0] + 1 if few else 1), 0
            for r in few:
                at[r[0]] = running
                running += r[i] or 0
            offsets = F.array(*[F.lit(v).cast(table.schema[name].dataType) for v in at])
            out, ends[name] = out.withColumn(f"_tp_off_{name}", F.get(offsets, F.col(_PID).cast("int"))), running
        return out, ends
    total = table.agg(*[F.sum(c) for c in names], F.count("*")).first()
    offsets = _running_totals(table, names)
    offsets = F.broadcast(offsets) if total[-1] <= MAX_BROADCAST_OFFSETS else offsets
    return ranged.join(offsets, ranged[_PID] == offsets["_tp_opid"]).drop("_tp_opid"), dict(zip(names, total))


def with_row_index(
    df: DataFrame,
    order_by: Sequence[str | Column | Desc],
    index_col: str = ROW_INDEX,
    num_partitions: int | None = None,
) -> tuple[DataFrame, int]:
    """Attach a dense 0-based index following ``order_by`` (must be a total order), and count the rows.

    The rows are moved once, into stored ranges of the order; the index follows from a row's place and
    the sizes of the ranges before. Every execution of the result reads the same index. Descending keys
    are given as ``Desc``.
    """
    placed, ends = _with_offsets(ordered_ranges(df, order_by, num_partitions), {"n": F.count(F.lit(1))})
    indexed = placed.withColumn(index_col, F.col("_tp_off_n") + F.col(_PLACE))
    return indexed.drop(*[c for c in (_PID, _PLACE, "_tp_off_n") if c != index_col]), int(ends["n"] or 0)


def with_series_position(
    indexed: DataFrame,
    partition_by: Sequence[str],
    index_col: str = ROW_INDEX,
    position_col: str = "series_pos",
    length_col: str | None = None,
    bucket_rows: int | None = None,
) -> DataFrame:
    """Position inside the series = global index − first global index of the series.

    ``indexed`` must be indexed over ``partition_by + order_by`` so series are contiguous.
    Without series keys the position is the global index itself.

    The series start (and length) come from (series, bucket) segments: one row per segment,
    combined per series by a window over the small segment table, and joined back on
    (series, bucket). Every join key covers at most one bucket of rows, so a series holding a
    third of the table is still spread over many tasks.
    """
    if not partition_by:
        out = indexed.withColumn(position_col, F.col(index_col))
        if length_col:
            # one number for the whole table: an aggregate, not an unpartitioned window
            n = indexed.agg(F.max(index_col)).first()[0]
            out = out.withColumn(length_col, F.lit((n if n is not None else -1) + 1).cast("long"))
        return out
    pb = list(partition_by)
    B = _resolve_bucket(indexed, index_col, bucket_rows)
    data = indexed.withColumn("_tp_sb", _bucket(index_col, B))
    seg = data.groupBy(*pb, "_tp_sb").agg(F.min(index_col).alias("_tp_seg_start"),
                                          F.count(F.lit(1)).alias("_tp_seg_n"))
    w = Window.partitionBy(*pb)
    seg = seg.select(*[F.col(k).alias(f"_tp_k_{k}") for k in pb], F.col("_tp_sb").alias("_tp_sb_r"),
                     F.min("_tp_seg_start").over(w).alias("_tp_start"),
                     *([F.sum("_tp_seg_n").over(w).alias(length_col)] if length_col else []))
    cond = [data[k].eqNullSafe(seg[f"_tp_k_{k}"]) for k in pb] + [data["_tp_sb"] == seg["_tp_sb_r"]]
    joined = data.join(seg, cond, "inner")
    return joined.select(
        *[data[c] for c in indexed.columns],
        (F.col(index_col) - F.col("_tp_start")).alias(position_col),
        *([F.col(length_col)] if length_col else []),
    )


SALT_BUCKETS = 32
# A group is hot above so many rows, and above such a share of all rows: a bound on the number of hot groups.
HOT_ROWS, HOT_SHARE = 1 << 20, 1 << 21
# Up to so many hot groups are literals of the plan; more are a table of 8 bytes each (at most HOT_SHARE rows).
MAX_LITERAL_GROUPS = 256


def join_group_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str], salt: int = SALT_BUCKETS,
                     how: str = "inner", hot_rows: int | None = None) -> DataFrame:
    """Attach one-row-per-group statistics to every row of ``df`` with a join that hot groups do not skew.

    Every group above ``hot_rows`` rows (and a 2^21st of all rows, so that the list is bounded) is hot: its
    rows get a salt from a hash of their content (deterministic on recomputation) and its statistics are
    copied once per salt; all other groups are joined as they are. Null keys match (null-safe).
    """
    keys = list(keys)
    group = F.xxhash64(*keys)
    counts = df.groupBy(group.alias("_tp_g")).agg(F.count(F.lit(1)).alias("n"))
    large = counts.where(F.col("n") > (HOT_ROWS if hot_rows is None else hot_rows))
    hot = [r[0] for r in large.select("_tp_g").limit(MAX_LITERAL_GROUPS + 1).collect()]
    if len(hot) <= MAX_LITERAL_GROUPS:
        def marked(rows: DataFrame, name: str) -> DataFrame:
            return rows.withColumn(name, group.isin(hot) if hot else F.lit(False))
    else:
        least = int(counts.agg(F.sum("n")).first()[0]) // HOT_SHARE
        listed = F.broadcast(large.where(F.col("n") > least).select("_tp_g", F.lit(True).alias("_tp_in")))

        def marked(rows: DataFrame, name: str) -> DataFrame:
            known = rows.withColumn("_tp_h", group).join(listed, F.col("_tp_h") == F.col("_tp_g"), "left")
            return known.withColumn(name, F.col("_tp_in").isNotNull()).drop("_tp_h", "_tp_g", "_tp_in")
    salted = marked(df, "_tp_hot").withColumn("_tp_salt", F.when(F.col("_tp_hot"), F.pmod(F.xxhash64(*df.columns), F.lit(salt))).otherwise(F.lit(0).cast("long")))
    rep = marked(stats, "_tp_hot_r").select(
        *[F.col(k).alias(f"_tp_g_{k}") for k in keys], *[F.col(c) for c in stats.columns if c not in keys],
        F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("_tp_hot_r"), salt - 1).otherwise(0).cast("long"))).alias("_tp_salt_r"))
    cond = [salted[k].eqNullSafe(rep[f"_tp_g_{k}"]) for k in keys] + [salted["_tp_salt"] == rep["_tp_salt_r"]]
    out = salted.join(rep, cond, how)  # "left" keeps rows whose group has no statistics row
    return out.drop("_tp_salt", "_tp_salt_r", "_tp_hot", *[f"_tp_g_{k}" for k in keys])


def auto_bucket_rows(spark, n: int | None, span: int = 1) -> int:
    """Rows per bucket: enough buckets to use every shuffle partition, at most DEFAULT_BUCKET_ROWS
    (bounded task memory), at least ``span`` (the halo covers one neighbouring bucket)."""
    if n is None:
        return max(DEFAULT_BUCKET_ROWS, span)
    per_part = -(-int(n) // default_partitions(spark))
    return max(span, min(DEFAULT_BUCKET_ROWS, per_part), 1)


def _resolve_bucket(indexed: DataFrame, index_col: str, bucket_rows: int | None, span: int = 1) -> int:
    if bucket_rows:
        return max(int(bucket_rows), span)
    return auto_bucket_rows(indexed.sparkSession, _row_count(indexed, index_col), span)


def _row_count(indexed: DataFrame, index_col: str) -> int:
    top = indexed.agg(F.max(index_col)).first()[0]
    return 0 if top is None else top + 1


def _bucket_tasks(indexed: DataFrame, index_col: str, bucket_rows: int, n_rows: int | None) -> int:
    """Tasks for bucketed work: one a bucket of counted rows, at least the session's."""
    n = _row_count(indexed, index_col) if n_rows is None else n_rows
    return max(default_partitions(indexed.sparkSession), -(-n // bucket_rows))


def _bucket(index_col: str, bucket_rows: int) -> Column:
    return F.floor(F.col(index_col) / F.lit(bucket_rows)).cast("long")


def fill_ordered(
    indexed: DataFrame,
    columns: Sequence[str],
    index_col: str = ROW_INDEX,
    partition_by: Sequence[str] = (),
    backward: bool = False,
    bucket_rows: int | None = None,
    backward_columns: Sequence[str] = (),
    n_rows: int | None = None,
) -> DataFrame:
    """Forward (or backward) fill ``columns`` along ``index_col`` within optional series.

    Leading nulls stay null for a forward fill, trailing nulls for a backward fill. With
    ``backward=False``, ``backward_columns`` are filled backward in the same pass.
    """
    if not columns and not backward_columns:
        return indexed
    pb = list(partition_by)
    b = "_tp_bucket"
    bucket_rows = _resolve_bucket(indexed, index_col, bucket_rows)
    data = indexed.withColumn(b, _bucket(index_col, bucket_rows))
    # the per-bucket window and the carry aggregate reuse this partitioning
    data = data.repartition(_bucket_tasks(indexed, index_col, bucket_rows, n_rows), *pb, b)
    fwd = [] if backward else list(columns)
    bwd = list(columns) if backward else list(backward_columns)
    return _fill_pass(data, indexed.columns, fwd, bwd, index_col, pb, b)


def _fill_pass(data: DataFrame, out_columns: Sequence[str], fwd: Sequence[str], bwd: Sequence[str],
               index_col: str, pb: list[str], b: str) -> DataFrame:
    """One bucketed pass filling ``fwd`` columns forward and ``bwd`` columns backward.

    Both directions share the exchange into buckets, one carry aggregate and one join. A backward fill
    is a forward fill of the descending order: a frame that ends with its partition is evaluated anew
    for every row, one that begins with it grows.
    """
    grp = pb + [b]
    w_sorted = Window.partitionBy(*grp).orderBy(index_col)
    w_fwd = w_sorted.rowsBetween(Window.unboundedPreceding, 0)
    w_bwd = Window.partitionBy(*grp).orderBy(F.col(index_col).desc()).rowsBetween(Window.unboundedPreceding, 0)

    # carry table: per (series, bucket) the last non-null value (forward) and the first (backward)
    def tagged(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col(index_col).alias("i"), F.col(c).alias("v")))

    carry = data.groupBy(*grp).agg(
        *[F.max(tagged(c)).getField("v").alias(f"_tp_lf_{c}") for c in fwd],
        *[F.min(tagged(c)).getField("v").alias(f"_tp_lb_{c}") for c in bwd],
    )
    w_cf = Window.partitionBy(*pb).orderBy(F.col(b)).rowsBetween(Window.unboundedPreceding, -1)
    w_cb = Window.partitionBy(*pb).orderBy(F.col(b).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(
        *[F.col(k).alias(f"_tp_ck_{k}") for k in grp],
        *[F.last(f"_tp_lf_{c}", True).over(w_cf).alias(f"_tp_if_{c}") for c in fwd],
        *[F.last(f"_tp_lb_{c}", True).over(w_cb).alias(f"_tp_ib_{c}") for c in bwd],
    )
    local = data.select(
        *[F.col(c) for c in data.columns],
        *[F.last(c, True).over(w_fwd).alias(f"_tp_f_{c}") for c in fwd],
        *[F.last(c, True).over(w_bwd).alias(f"_tp_b_{c}") for c in bwd],
    )
    cond = [local[k].eqNullSafe(carry[f"_tp_ck_{k}"]) for k in grp]
    joined = local.join(carry, cond, "left")
    out_cols = []
    for c in out_columns:
        if c in fwd:
            out_cols.append(F.coalesce(F.col(f"_tp_f_{c}"), F.col(f"_tp_if_{c}")).alias(c))
        elif c in bwd:
            out_cols.append(F.coalesce(F.col(f"_tp_b_{c}"), F.col(f"_tp_ib_{c}")).alias(c))
        else:
            out_cols.append(F.col(c))
    return joined.select(*out_cols)


def halo_frames(
    indexed: DataFrame,
    span: int,
    collect: dict[str, Column],
    index_col: str = ROW_INDEX,
    partition_by: Sequence[str] = (),
    keep: Sequence[str] = (),
    bucket_rows: int | None = None,
    n_rows: int | None = None,
) -> DataFrame:
    """All complete frames of ``span`` consecutive rows (stride 1), one row per frame start.

    ``collect`` maps output names to per-row expressions gathered into arrays of length ``span``.
    With ``partition_by`` a frame never crosses a series boundary (series must be contiguous in
    the index). ``keep`` columns are taken from the frame's first row.
    """
    if span < 1:
        raise ValueError("span must be >= 1")
    B = _resolve_bucket(indexed, index_col, bucket_rows, span)
    i = F.col(index_col)
    lo = F.greatest(F.lit(0).cast("long"), F.floor((i - F.lit(span - 1)) / F.lit(B)).cast("long"))
    hi = F.floor(i / F.lit(B)).cast("long")
    pb = list(partition_by)
    staged = indexed.select(
        i.alias(index_col),
        *[F.col(k) for k in pb],
        *[F.col(k) for k in keep if k not in pb and k != index_col],
        *[expr.alias(f"_tp_c_{name}") for name, expr in collect.items()],
        F.explode(F.sequence(lo, hi)).alias("_tp_b"),
    )
    # the window reuses this partitioning
    staged = staged.repartition(_bucket_tasks(indexed, index_col, B, n_rows), "_tp_b")
    w = Window.partitionBy("_tp_b").orderBy(index_col).rowsBetween(0, span - 1)
    framed = staged.select(
        F.col(index_col),
        F.col("_tp_b"),
        *[F.col(k) for k in pb],
        *[F.col(k) for k in keep if k not in pb and k != index_col],
        F.count(F.lit(1)).over(w).alias("_tp_n"),
        *[F.last(F.col(k)).over(w).alias(f"_tp_end_{k}") for k in pb],
        *[F.collect_list(f"_tp_c_{name}").over(w).alias(name) for name in collect],
    )
    cond = (F.col("_tp_b") == F.floor(F.col(index_col) / F.lit(B)).cast("long")) & (F.col("_tp_n") == span)
    for k in pb:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_tp_end_{k}"))
    return framed.where(cond).drop("_tp_b", "_tp_n", *[f"_tp_end_{k}" for k in pb])


def with_prefix_sums(
    df: DataFrame,
    order_by: Sequence[str | Column | Desc],
    columns: Sequence[str],
    num_partitions: int | None = None,
    suffix: str = "_cum",
) -> DataFrame:
    """Running sums of ``columns`` along a total order, without a single-partition window.

    The rows are stored in ranges of the order; the window runs inside each range only, and the totals
    of the ranges before are added.
    """
    ranged = ordered_ranges(df, order_by, num_partitions)
    placed, _ = _with_offsets(ranged, {c: F.sum(c) for c in columns})
    w = Window.partitionBy(_PID).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, 0)
    return placed.select(*df.columns, *[(F.sum(c).over(w) + F.col(f"_tp_off_{c}")).alias(f"{c}{suffix}") for c in columns])
