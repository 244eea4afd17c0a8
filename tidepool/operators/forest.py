"""The fit of MLlib's random forests (#91, #92) on many rows.

A tree sees of a row only the bins of its features, so rows that share bins and label are counted once. MLlib draws
for every row and tree how often the tree holds the row, from Poisson(1); of n such rows a tree holds Poisson(n). Those
are drawn once for every unit (bins, label, n) and tree and summed over each combination of bins, so that a tree is grown
whole by one task, from as many sums as there are combinations. Bins a feature, features tried at a node, impurity,
gains, stopping and pruning are MLlib's, and so is the fitted model: nodes are written as MLlib stores them.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml import Estimator
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.columns import list_matrix
from tidepool.operators.boosting import feature_cuts
from tidepool.session import drop_folder, learner_tasks, scratch_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Combinations of bins that one task holds for a tree (four features of MLlib's 32 bins); beyond them MLlib fits.
MAX_COMBINATIONS = 1 << 20
# Units drawn at once, combinations whose sums a task holds, nodes whose histograms it holds.
DRAW_UNITS, HELD, HELD_NODES = 1024, 1 << 13, 1024
# Classes that MLlib takes.
MAX_CLASSES = 100
# MLlib takes a child of less impurity for pure.
PURE = float(np.finfo(float).eps)

# Poisson(1) of 16 random bits; REST marks what 16 bits cannot tell, drawn from what is left of each chance.
_CHANCES = np.array([math.exp(-1) / math.factorial(k) for k in range(20)])
_SHARES = np.floor(_CHANCES * (1 << 16)).astype(int)
REST = 255
_DRAWS = np.full(1 << 16, REST, dtype=np.uint8)
_DRAWS[:_SHARES.sum()] = np.repeat(np.arange(20), _SHARES)
_LEFT = _CHANCES * (1 << 16) - _SHARES


def held_rows(rnd: np.random.Generator, n: np.ndarray, trees: int) -> np.ndarray:
    """How many of its ``n`` rows each tree holds of a unit (unit, tree): Poisson(n)."""
    out = _DRAWS[rnd.integers(0, 1 << 16, (len(n), trees), dtype=np.uint16)]
    rest = out == REST
    if rest.any():
        out[rest] = rnd.choice(20, rest.sum(), p=_LEFT / _LEFT.sum())
    out = out.astype(np.float64)
    more = n > 1
    if more.any():
        out[more] = rnd.poisson(n[more, None], (int(more.sum()), trees))
    return out


def _binned(cuts: list[list[float]], n_classes: int):
    """Each row's combination of bins, numbered, and its label. ``n_classes`` 0: a number."""
    sizes = [len(c) + 1 for c in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if batch.column("x").null_count or batch.column("y").null_count:
                raise ValueError("features and labels must not be null")
            x, y = list_matrix(batch.column("x")), batch.column("y").to_numpy()
            if x.shape[1] != len(cuts) or not np.isfinite(x).all() or not np.isfinite(y).all():
                raise ValueError(f"features must be {len(cuts)} finite numbers, labels finite")
            if n_classes and not np.isin(y, np.arange(n_classes)).all():
                raise ValueError(f"classes must be whole numbers in 0..{n_classes - 1}")
            cell = np.zeros(len(x), dtype=np.int64)
            for v, c, size in zip(x.T, cuts, sizes):
                cell = cell * size + np.searchsorted(c, v)
            yield pa.record_batch([pa.array(cell), pa.array(y)], names=["cell", "y"])

    return run


_BLOCK, _NAMES = "tree int, place bigint, cells binary, sums binary", ["tree", "place", "cells", "sums"]


def _drawn(seed: int, trees: int, n_classes: int):
    """For each tree the sums of what it holds over the combinations of a task's units, which come ordered by combination:
    rows of each class, or (rows, sum, sum of squares)."""
    width = n_classes or 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rnd, place = np.random.default_rng([seed, TaskContext.get().partitionId()]), TaskContext.get().partitionId() << 32
        cells, sums, held = [], [], 0

        def block() -> pa.RecordBatch:
            where, every = np.concatenate(cells).tobytes(), np.concatenate(sums)
            return pa.record_batch([pa.array(range(trees), pa.int32()), pa.array([place] * trees, pa.int64()), pa.array([where] * trees, pa.binary()),
                                    pa.array([np.ascontiguousarray(every[:, t]).tobytes() for t in range(trees)], pa.binary())], names=_NAMES)

        for batch in batches:
            every = [batch.column(c).to_numpy() for c in ("cell", "y", "n")]
            for at in range(0, batch.num_rows, DRAW_UNITS):
                cell, y, n = (c[at:at + DRAW_UNITS] for c in every)
                drawn = held_rows(rnd, n, trees)
                first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                if n_classes:
                    parts = [np.add.reduceat(drawn * (y == k)[:, None], first) for k in range(n_classes)]
                else:
                    parts = [np.add.reduceat(drawn, first)]
                    for _ in range(2):
                        drawn *= y[:, None]
                        parts.append(np.add.reduceat(drawn, first))
                cells.append(cell[first])
                sums.append(np.stack(parts, axis=2))
                held += len(first)
                if held >= HELD:
                    yield block()
                    cells, sums, held, place = [], [], 0, place + 1
        if held:
            yield block()

    return run


def impurities(sums: np.ndarray, classes: bool) -> tuple[np.ndarray, np.ndarray]:
    """(rows, impurity) of sums whose last axis is rows of each class (Gini) or (rows, sum, sum of squares) (variance)."""
    if classes:
        rows = sums.sum(axis=-1)
        return rows, np.where(rows > 0, 1.0 - ((sums / np.maximum(rows, 1.0)[..., None]) ** 2).sum(axis=-1), 0.0)
    rows, total, squares = np.moveaxis(sums, -1, 0)
    some = np.maximum(rows, 1.0)
    return rows, np.where(rows > 0, (squares - total * total / some) / some, 0.0)


def _sums_of_bins(bins: np.ndarray, sums: np.ndarray, node: np.ndarray, n_nodes: int, n_bins: int) -> np.ndarray:
    """(node, feature, bin, sum)."""
    out = np.empty((n_nodes, bins.shape[1], n_bins, sums.shape[1]))
    for f in range(bins.shape[1]):
        at = node * n_bins + bins[:, f]
        for s in range(sums.shape[1]):
            out[:, f, :, s] = np.bincount(at, sums[:, s], minlength=n_nodes * n_bins).reshape(n_nodes, n_bins)
    return out


def grow(bins: np.ndarray, sums: np.ndarray, sizes: list[int], classes: bool, tried: int, max_depth: int, min_rows: int, rnd: np.random.Generator) -> dict[str, list]:
    """A tree's nodes, level by level: split (feature, bin; rows up to the bin go left), children (0: none), sums, impurity,
    gain. ``tried`` features are drawn for each node. As MLlib: the split of largest gain, ties by the first feature and bin;
    a node without gain, at ``max_depth`` or pure is a leaf; children hold ``min_rows`` rows at least; a leaf that no split
    could have divided has impurity -1."""
    whole = sums.sum(axis=0)
    tree = {"feature": [-1], "bin": [0], "left": [0], "sums": [whole], "impurity": [float(impurities(whole, classes)[1])], "gain": [-1.0]}
    n_bins, may = max(sizes), np.array([s > 1 for s in sizes])
    inside = np.arange(max(sizes))[None, :] < np.array(sizes)[:, None] - 1
    open_nodes, node = [0], np.zeros(len(bins), dtype=np.int64)
    for depth in range(max_depth):
        if not open_nodes:
            break
        order = np.argsort(node, kind="stable")
        bins, sums, node = bins[order], sums[order], node[order]
        children, after = [], np.full(len(node), -1, dtype=np.int64)
        for at in range(0, len(open_nodes), HELD_NODES):
            some = open_nodes[at:at + HELD_NODES]
            rows = slice(*np.searchsorted(node, [at, at + len(some)]))
            b, s, own = bins[rows], sums[rows], node[rows] - at
            low = np.cumsum(_sums_of_bins(b, s, own, len(some), n_bins), axis=2)
            total = low[:, :, -1:, :]
            (n_low, i_low), (n_high, i_high), (n, i) = (impurities(x, classes) for x in (low, total - low, total))
            gain = i - n_low / n * i_low - n_high / n * i_high
            chosen = np.argsort(rnd.random((len(some), len(sizes))), axis=1).argsort(axis=1) < tried
            valid = (n_low >= min_rows) & (n_high >= min_rows) & (gain >= 0) & inside & (chosen & may)[:, :, None]
            gain = np.where(valid, gain, -1.0).reshape(len(some), -1)
            best = gain.argmax(axis=1)
            value, (feature, cut) = gain[np.arange(len(some)), best], np.divmod(best, n_bins)
            goes = np.full((len(some), 2), -1, dtype=np.int64)
            for k, id_ in enumerate(some):
                if value[k] < 0:
                    tree["impurity"][id_] = -1.0
                if value[k] <= 0:
                    continue
                f, c, first = int(feature[k]), int(cut[k]), len(tree["feature"])
                tree["feature"][id_], tree["bin"][id_], tree["left"][id_], tree["gain"][id_] = f, c, first, float(value[k])
                sides = low[k, f, c], total[k, f, 0] - low[k, f, c]
                for side, (part, pure) in enumerate(zip(sides, (i_low[k, f, c], i_high[k, f, c]))):
                    for name, v in (("feature", -1), ("bin", 0), ("left", 0), ("sums", part), ("impurity", float(pure)), ("gain", -1.0)):
                        tree[name].append(v)
                    if abs(pure) >= PURE:
                        goes[k, side] = len(children)
                        children.append(first + side)
            right = b[np.arange(len(b)), feature[own]] > cut[own]
            after[rows] = np.where(value[own] > 0, goes[own, right.astype(np.int64)], -1)
        going = after >= 0
        bins, sums, node, open_nodes = bins[going], sums[going], after[going], children
    return tree


_NODES = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
          "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")


def nodes_of(tree: dict[str, list], cuts: list[list[float]], classes: bool) -> list[dict]:
    """The nodes as MLlib stores them: numbered from the root down, left before right; leaves of one prediction that share
    a parent are pruned."""
    value = [float(np.argmax(s)) if classes else float(s[1] / s[0]) if s[0] else 0.0 for s in tree["sums"]]
    leaf = [left == 0 for left in tree["left"]]
    for k in range(len(leaf) - 1, -1, -1):  # children stand behind their parent
        left = tree["left"][k]
        leaf[k] = leaf[k] or leaf[left] and leaf[left + 1] and value[left] == value[left + 1]
    out, waiting = [], [(0, -1)]
    while waiting:
        k, above = waiting.pop()
        id_, s = len(out), tree["sums"][k]
        rows = float(s.sum() if classes else s[0])
        if above >= 0:
            out[above]["leftChild" if out[above]["leftChild"] < 0 else "rightChild"] = id_
        split = {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}
        if not leaf[k]:
            f = tree["feature"][k]
            split = {"featureIndex": f, "leftCategoriesOrThreshold": [float(cuts[f][tree["bin"][k]])], "numCategories": -1}
            waiting += [(tree["left"][k] + 1, id_), (tree["left"][k], id_)]
        out.append({"id": id_, "prediction": value[k], "impurity": tree["impurity"][k], "impurityStats": s.tolist(), "rawCount": round(rows),
                    "gain": -1.0 if leaf[k] else tree["gain"][k], "leftChild": -1, "rightChild": -1, "split": split})
    return out


def _grown(cuts: list[list[float]], n_classes: int, tried: int, max_depth: int, min_rows: int, seed: int):
    sizes, width = [len(c) + 1 for c in cuts], n_classes or 3
    nodes = pa.struct([("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()),
                       ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
                       ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())]))])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")  # as they come, equal combinations would be added in any order
        which = group.column("tree")[0].as_py()
        cells = np.concatenate([np.frombuffer(b.as_py(), dtype=np.int64) for b in group.column("cells")])
        sums = np.concatenate([np.frombuffer(b.as_py()).reshape(-1, width) for b in group.column("sums")])
        order = np.argsort(cells, kind="stable")
        bins = np.stack(np.unravel_index(cells[order], sizes), axis=1).astype(np.uint8)
        tree = grow(bins, sums[order], sizes, n_classes > 0, tried, max_depth, min_rows, np.random.default_rng([seed, which]))
        found = nodes_of(tree, cuts, n_classes > 0)
        return pa.table({"treeID": pa.array([which] * len(found), pa.int32()), "nodeData": pa.array(found, nodes)})

    return run


class Forest(Estimator):
    """Fits what the MLlib estimator ``est`` (all rows, bootstrapped) describes, on the rows as they are dealt."""

    def __init__(self, est: RandomForestClassifier | RandomForestRegressor):
        super().__init__()
        self.est = est

    def _fit(self, dataset: DataFrame):
        est, spark = self.est, dataset.sparkSession
        classes = isinstance(est, RandomForestClassifier)
        features, label = est.getFeaturesCol(), est.getLabelCol()
        folder = scratch_folder(spark)
        rows = dataset.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
        rows.write.parquet(f"{folder}/rows")
        rows = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
        n, width, top = rows.agg(F.count("*"), F.max(F.size("x")), F.max("y")).first()
        cuts, n_classes = feature_cuts(rows, width, min(est.getMaxBins(), n)), int(top) + 1 if classes else 0
        if math.prod(len(c) + 1 for c in cuts) > MAX_COMBINATIONS or n_classes > MAX_CLASSES:
            drop_folder(spark, folder)
            return est.fit(dataset)
        trees, seed, tasks = est.getNumTrees(), est.getSeed() % (1 << 63), learner_tasks(spark, n) or 1
        tried = width if trees == 1 else math.ceil(math.sqrt(width) if classes else width / 3)
        cells = rows.mapInArrow(_binned(cuts, n_classes), "cell bigint, y double")
        # a combination's units meet in one task, those of more rows than a task's share in several
        heavy = cells.groupBy("cell").agg(F.ceil(F.count("*") * tasks / n).alias("parts")).where("parts > 1")
        units = cells.groupBy("cell", "y").agg(F.count("*").alias("n")).join(F.broadcast(heavy), "cell", "left")
        units = units.withColumn("part", F.pmod(F.xxhash64("y"), F.coalesce("parts", F.lit(1))))
        units = units.repartition(tasks, "cell", "part").sortWithinPartitions("cell", "y").select("cell", "y", "n")
        sums = units.mapInArrow(_drawn(seed, trees, n_classes), _BLOCK).repartition(min(trees, tasks), "tree")
        grown = sums.groupBy("tree").applyInArrow(_grown(cuts, n_classes, tried, est.getMaxDepth(), est.getMinInstancesPerNode(), seed), _NODES)
        # MLlib's model of a row for each class holds all but the trees' nodes
        few = spark.createDataFrame([(Vectors.dense([0.0] * width), float(k)) for k in range(max(1, n_classes))], [features, label])
        est.fit(few).write().save(f"{folder}/model")
        grown.write.mode("overwrite").parquet(f"{folder}/model/data")
        model = (RandomForestClassificationModel if classes else RandomForestRegressionModel).load(f"{folder}/model")
        drop_folder(spark, folder)
        return model
