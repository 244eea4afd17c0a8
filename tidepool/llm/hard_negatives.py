"""Hard-negative mining with bounds along a spanning tree of the anchors.

Vectors are scaled to integers; a score is an inner product. For a child anchor c with parent p in the
tree, ``x.c = x.p + x.(c - p)``, so the child's score lies within ``|c - p| * |x|`` of the parent's. A
task walks the tree from its root: bounds of a row's score widen by edge length times norm, and only
rows whose bounds overlap the anchor's window are scored again, exactly, which closes their bounds for
the children.

1. **Trees.** Anchors are dealt to blocks of bounded size; each block gets its minimum spanning tree.
2. **Positives.** Every group of rows meets every block of anchors (keys of both: a group and a block,
   each of bounded size). The window is what can still be among the best of the anchor's own label.
3. **Negatives.** The same with the windows of the anchor's positives: from a share of a positive's score
   up to that score, other labels, the best so far raising the lower end.

Each task returns a few rows an anchor, merged by ranking; no score of a row outside the windows is kept.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.llm.common import table, written
from tidepool.session import scratch_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, EVERY, POSITIVES, NEGATIVES, PERCENT = 256, 100, 5, 5, 80
GROUP_ROWS, ANCHOR_ROWS, STEP_ROWS = 1 << 16, 1 << 10, 1 << 12
TREES = "block bigint, at int, vec_id bigint, label bigint, vector array<bigint>, parent int, length double"


def _matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """The vectors as rows; shorter ones are filled with zeros."""
    vectors = column.combine_chunks()
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), max(int(sizes.max(initial=0)), width or 0)), dtype=np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def spanning_tree(x: np.ndarray) -> tuple[list[int], list[int], list[float]]:
    """Prim's order of the rows, each one's parent as a place in that order (-1: the root), and the
    length of the edge to it."""
    order, parent, length = [0], [-1], [0.0]
    place, near = np.zeros(len(x), dtype=np.int64), np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    near[0] = np.inf
    for at in range(1, len(x)):
        new = int(near.argmin())
        order.append(new)
        parent.append(int(place[new]))
        length.append(float(near[new]))
        d = np.sqrt(((x - x[new]) ** 2).sum(axis=1))
        closer = (d < near) & np.isfinite(near)
        near[closer], place[closer] = d[closer], at
        near[new] = np.inf
    return order, parent, length


def _plant(anchors: pa.Table) -> pa.Table:
    anchors = anchors.sort_by("vec_id")
    order, parent, length = spanning_tree(_matrix(anchors.column("vector")).astype(np.float64))
    rows = anchors.take(order)
    return pa.table([rows.column("block"), pa.array(range(len(order)), pa.int32()), rows.column("vec_id"), rows.column("label"),
                     rows.column("vector"), pa.array(parent, pa.int32()), length], names=["block", "at", "vec_id", "label", "vector", "parent", "length"])


class _Rows:
    """The rows of a group, scored a few thousand at a time."""

    def __init__(self, rows: pa.Table, anchors: pa.Table):
        width = max(int(pc.max(pc.list_value_length(t.column("vector"))).as_py() or 0) for t in (rows, anchors))
        self.ids, self.labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
        self.whole, self.targets = _matrix(rows.column("vector"), width), _matrix(anchors.column("vector"), width)
        self.x, self.c = self.whole.astype(np.float64), self.targets.astype(np.float64)
        self.norms = np.sqrt((self.x ** 2).sum(axis=1))
        largest = [float(np.abs(m).max(initial=0)) for m in (self.x, self.c)]
        self.plain = width * largest[0] * largest[1] < 2.0 ** 53  # float sums are exact

    def scores(self, rows: np.ndarray, anchor: int) -> np.ndarray:
        if self.plain:
            return (self.x[rows] @ self.c[anchor]).astype(np.int64)
        exact = self.whole[rows].astype(object) @ self.targets[anchor].astype(object)
        return np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in exact], dtype=np.int64)

    def walk(self, parents: list[int], lengths: list[float], wanted, found) -> None:
        """``wanted(anchor, rows, low, high)``: which of the rows to score, by their bounds;
        ``found(anchor, rows, scores)`` gets those."""
        for start in range(0, len(self.ids), STEP_ROWS):
            rows = np.arange(start, min(start + STEP_ROWS, len(self.ids)))
            low, high = np.empty((len(parents), len(rows))), np.empty((len(parents), len(rows)))
            for i, (p, length) in enumerate(zip(parents, lengths)):
                if p < 0:
                    low[i] = high[i] = self.scores(rows, i)
                else:  # a little wider than exact arithmetic asks for
                    reach = length * (1 + 1e-9) * self.norms[rows]
                    low[i] = low[p] - reach - 1e-12 * np.abs(low[p])
                    high[i] = high[p] + reach + 1e-12 * np.abs(high[p])
                need = np.flatnonzero(wanted(i, rows, low[i], high[i]))
                if len(need):
                    low[i, need] = high[i, need] = scores = self.scores(rows[need], i)
                    found(i, rows[need], scores)


class _Best:
    """The best ``k`` (score, id): higher scores first, ties by the smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.r_[self.scores, scores], np.r_[self.ids, ids]
        order = np.lexsort((ids, ~scores))[:self.k]  # ~s falls as s rises, without overflow
        self.scores, self.ids = scores[order], ids[order]

    def floor(self, least: float) -> float:
        """What a score must reach to be among the best; a little less where floats round."""
        if len(self.ids) < self.k:
            return least
        s = int(self.scores[-1])
        return float(s) if abs(s) < 1 << 53 else s - 1e-12 * abs(s)


FOUND = pa.schema([("anchor_id", pa.int64()), ("j", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _result(best: Iterator[tuple[int, int, _Best]]) -> pa.Table:
    rows = [(anchor, j, int(i), int(s)) for anchor, j, b in best for s, i in zip(b.scores, b.ids)]
    cols = list(zip(*rows)) or [[]] * len(FOUND)
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, FOUND)], schema=FOUND)


def _positives(k: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not (rows.num_rows and anchors.num_rows):
            return FOUND.empty_table()
        anchors = anchors.sort_by("at")
        ids, labels, parents, lengths = (anchors.column(c).to_pylist() for c in ("vec_id", "label", "parent", "length"))
        group, best = _Rows(rows, anchors), [_Best(k) for _ in ids]

        def wanted(i, at, low, high):
            return (group.labels[at] == labels[i]) & (group.ids[at] != ids[i]) & (high >= best[i].floor(-np.inf))

        group.walk(parents, lengths, wanted, lambda i, at, scores: best[i].add(scores, group.ids[at]))
        return _result((a, 0, b) for a, b in zip(ids, best))

    return run


def _negatives(k: int, percent: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not (rows.num_rows and anchors.num_rows):
            return FOUND.empty_table()
        anchors = anchors.sort_by("at")
        ids, labels, parents, lengths, tops = (anchors.column(c).to_pylist() for c in ("vec_id", "label", "parent", "length", "tops"))
        group = _Rows(rows, anchors)
        # of each positive: its window (none below zero, as a share of it is above it) and the best in it
        windows = [[(-(-percent * s // 100), s, j, _Best(k)) for j, s in enumerate(top or (), 1) if s >= 0] for top in tops]

        def wanted(i, at, low, high):
            if not windows[i]:
                return np.zeros(len(at), dtype=bool)
            least = min(b.floor(lo) for lo, _, _, b in windows[i])
            return (group.labels[at] != labels[i]) & (high >= least) & (low <= max(hi for _, hi, _, _ in windows[i]))

        def found(i, at, scores):
            for lo, hi, _, best in windows[i]:
                inside = (scores >= best.floor(lo)) & (scores <= hi)
                if inside.any():
                    best.add(scores[inside], group.ids[at[inside]])

        group.walk(parents, lengths, wanted, found)
        return _result((a, j, b) for a, w in zip(ids, windows) for _, _, j, b in w)

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "j").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def scaled_rows(vectors: DataFrame, label: Column, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, components scaled and rounded down."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    whole = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    rows = (vectors.filter(F.col(id_col).isNotNull() & label.isNotNull() & x.isNotNull() & finite)
            .select(F.col(id_col).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), whole.alias("vector")))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.label", "row.vector")


def hard_negatives(vectors: DataFrame, label: Column | None = None, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   percent: int = PERCENT, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   group_rows: int = GROUP_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``. A component x counts as floor(scale * x); a
    score is the inner product with the anchor, higher first, ties by the smaller id. An anchor's
    positives are its first ``positives`` other rows of its label; for each of them, the first
    ``negatives`` rows of other labels whose score is at most the positive's and at least ``percent``
    per cent of it are returned, ranked from 1 (none if the positive's score is below zero).

    Rows with a null id, label, vector or component, or a component that is not finite, take no part. Of
    rows with one id the least by (label, vector) counts. Vectors of different lengths are filled with
    zeros. Scores beyond a long are cut to its range. An empty table, and one without anchors, give no
    rows. ``label``: an expression in place of ``label_col``. Other columns are not read.
    """
    spark = vectors.sparkSession
    folder = scratch_folder(spark)
    rows = written(scaled_rows(vectors, F.col(label_col) if label is None else label, scale, id_col, vector_col), folder, "rows")
    is_anchor = F.col("vec_id") % every == 0
    n, n_anchors = rows.agg(F.count("*"), F.count_if(is_anchor)).first()
    groups, blocks = max(1, -(-n // group_rows)), max(1, -(-n_anchors // anchor_rows))
    dealt = rows.filter(is_anchor).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)))
    trees = written(dealt.groupBy("block").applyInArrow(_plant, TREES), folder, "trees")

    # rows go once to every block of anchors, anchors once to every group of rows
    to_blocks = (rows.withColumn("row_group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)))
                 .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))))

    def meet(anchors: DataFrame, make) -> DataFrame:
        to_groups = anchors.withColumn("row_group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
        return (to_blocks.groupBy("row_group", "block").cogroup(to_groups.groupBy("row_group", "block"))
                .applyInArrow(make, "anchor_id bigint, j bigint, vec_id bigint, score bigint"))

    best = _ranked(meet(trees, _positives(positives)), positives).select("anchor_id", F.col("rank").cast("bigint").alias("j"),
                                                                         F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    best = written(best, folder, "positives")
    tops = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("j", "positive_score"))).getField("positive_score").alias("tops"))
    asked = trees.join(tops, F.col("vec_id") == F.col("anchor_id"), "left").drop("anchor_id")
    mined = _ranked(meet(asked, _negatives(negatives, percent)), negatives)
    return (mined.join(best, ["anchor_id", "j"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, one label in seven moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label)


SQL = f"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  qualify row_number() over (partition by vec_id order by label, v) = 1),
s as (
  select a.vec_id as anchor_id, a.label as own, b.vec_id, b.label, list_dot_product(a.v, b.v)::bigint as score
  from v a join v b on a.vec_id % {EVERY} = 0 and a.vec_id <> b.vec_id),
p as (
  select *, row_number() over (partition by anchor_id order by score desc, vec_id) as j from s where label = own qualify j <= {POSITIVES})
select p.anchor_id, p.vec_id as positive_id,
       cast(row_number() over (partition by p.anchor_id, p.j order by s.score desc, s.vec_id) as integer) as rank,
       s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and s.label <> s.own and {PERCENT} * p.score <= 100 * s.score and s.score <= p.score
qualify rank <= {NEGATIVES}"""
