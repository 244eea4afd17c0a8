"""Second-order gradient boosting (#93): trees grown from histograms of gradients and Hessians.

Features are cut into bins once, and the binned rows are stored. For every level of a tree one pass sums
gradient, Hessian and rows per (class, node, feature, bin) in each task; the sums of all tasks meet per
(class, node, block of features), where the best split is found, so that only one row for each of those
reaches the driver. All classes of a round grow their trees in the same passes. A split's gain is
``GL^2/(HL+lambda) + GR^2/(HR+lambda) - G^2/(H+lambda)``, a leaf's value ``-G/(H+lambda)`` times the
learning rate. Margins are stored again after every round, so that a pass applies the growing trees only. Of many
rows those that share bins and class are alike to every tree: they are counted once and weigh their number.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions.columns import list_matrix
from tidepool.session import PACKED_WRITES, drop_folder, learner_tasks, packed_session, scratch_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_BINS, BLOCK_FEATURES = 256, 64


@dataclass(frozen=True)
class BoostParams:
    """``max_depth`` None is unbounded, which needs ``max_leaves``. A node is split if it has
    ``min_samples_split`` rows and each child ``min_samples_leaf`` rows and ``min_hessian``."""

    n_estimators: int = 100
    learning_rate: float = 0.1
    max_depth: int | None = 6
    max_leaves: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    min_hessian: float = 1e-3
    reg_lambda: float = 1.0
    max_bins: int = MAX_BINS

    def __post_init__(self):
        if self.max_depth is None and self.max_leaves is None:
            raise ValueError("give max_depth or max_leaves")
        if not 2 <= self.max_bins <= MAX_BINS:
            raise ValueError(f"max_bins must lie in 2..{MAX_BINS}")


@dataclass
class Tree:
    """Arrays over nodes; ``feature`` -1 marks a leaf. Rows with ``x <= threshold`` (or no value) go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, threshold: float) -> tuple[int, int]:
        left = len(self.feature)
        self.feature[node], self.cut[node], self.threshold[node], self.left[node] = feature, cut, threshold, left
        for column, empty in ((self.feature, -1), (self.cut, 0), (self.threshold, 0.0), (self.left, 0), (self.value, 0.0)):
            column.extend([empty, empty])
        return left, left + 1

    def walker(self, cuts: list, top: float) -> Callable[[np.ndarray], np.ndarray]:
        """A function that gives the node each row (binned, or with its values) ends in, by ``cuts``. A leaf
        leads to itself, as no value is above ``top``; so all rows take as many steps as the tree is deep."""
        nodes, inner = np.arange(len(self.feature), dtype=np.int32), np.array(self.feature) >= 0
        feature, left = np.where(inner, self.feature, 0).astype(np.int32), np.where(inner, self.left, nodes).astype(np.int32)
        cut, depth = np.where(inner, cuts, top), np.zeros(len(nodes), dtype=np.int32)
        for node in np.flatnonzero(inner):  # children stand behind their parent
            depth[left[node]] = depth[left[node] + 1] = depth[node] + 1

        def walk(columns: np.ndarray) -> np.ndarray:
            at, flat = np.zeros(len(columns), dtype=np.int32), np.ascontiguousarray(columns).reshape(-1)
            first = np.arange(len(columns), dtype=np.int64) * columns.shape[1]
            for _ in range(depth.max()):
                at = left[at] + (flat[first + feature[at]] > cut[at])
            return at

        return walk

    def on_bins(self) -> Callable[[np.ndarray], np.ndarray]:
        return self.walker([min(c, MAX_BINS) for c in self.cut], MAX_BINS)


@dataclass
class Boosted:
    """A fitted model: ``margins = base + sum of the trees' leaves``, one per class (one for two classes)."""

    task: str
    n_classes: int
    base: list[float]
    rounds: list[list[Tree]]

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(np.array(self.base), (len(x), 1))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, k] += np.array(tree.value)[tree.walker(tree.threshold, np.inf)(x)]
        return out

    def predict(self, df: DataFrame, features: str = "features") -> DataFrame:
        """``df`` with ``yhat`` (and ``probability`` for classes)."""
        model = self

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def scores(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            m = model.margins(np.stack(x.to_list()).astype(np.float64))
            return pd.Series(list(m if model.task == "regression" else probabilities(m)), dtype=object)

        out = df.withColumn("probability", scores(F.col(features).cast("array<double>")))
        if self.task == "regression":
            return out.withColumn("yhat", F.element_at("probability", 1)).drop("probability")
        best = F.array_position("probability", F.array_max("probability")) - 1
        return out.withColumn("yhat", best.cast("double"))

    def importance(self, names: list[str]) -> list[tuple[str, float]]:
        """(name, share of splits), ascending."""
        counts = np.bincount([f for trees in self.rounds for t in trees for f in t.feature if f >= 0], minlength=len(names))
        return sorted(zip(names, (counts / max(1, counts.sum())).tolist()), key=lambda t: t[1])

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(r, k, json.dumps(asdict(t))) for r, trees in enumerate(self.rounds) for k, t in enumerate(trees)]
        head = json.dumps({"task": self.task, "n_classes": self.n_classes, "base": self.base})
        spark.createDataFrame([(-1, 0, head), *rows], "round int, class int, tree string").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Boosted:
        head, *rows = spark.read.parquet(path).orderBy("round", "class").collect()
        model = Boosted(**json.loads(head["tree"]), rounds=[])
        for r in rows:
            if r["class"] == 0:
                model.rounds.append([])
            model.rounds[-1].append(Tree(**json.loads(r["tree"])))
        return model


def probabilities(margins: np.ndarray) -> np.ndarray:
    """Of each class: logistic for one margin, softmax for several."""
    if margins.shape[1] == 1:
        p = 1 / (1 + np.exp(-margins[:, 0]))
        return np.column_stack([1 - p, p])
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def derivatives(task: str, margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the loss (half the squared error, or log loss) by each margin."""
    if task == "regression":
        return margins - y[:, None], np.ones_like(margins)
    p = probabilities(margins)
    if margins.shape[1] == 1:
        return p[:, 1:] - y[:, None], p[:, 1:] * p[:, :1]
    k = margins.shape[1]
    return p - (y[:, None] == np.arange(k)), p * (1 - p) * k / (k - 1)


def feature_cuts(rows: DataFrame, n_features: int, max_bins: int) -> list[list[float]]:
    """Ascending thresholds of each feature: all its values but the last if those are few, else quantiles."""
    x = [F.get("x", F.lit(i)) for i in range(n_features)]
    known = [F.when(~F.isnan(c), c) for c in x]
    few = rows.agg(*[F.approx_count_distinct(c, 0.02) for c in known]).first()
    grid = [i / max_bins for i in range(1, max_bins)]
    wanted = [F.sort_array(F.collect_set(c)) if n < 0.9 * max_bins else F.percentile_approx(c, grid, 100 * max_bins) for c, n in zip(known, few)]
    cuts = []
    for values, n in zip(rows.agg(*wanted).first(), few):
        values = sorted(set(values or []))
        cuts.append(values[:-1][:max_bins - 1] if n < 0.9 * max_bins else values[:max_bins - 1])
    return cuts


# Stored rows are packed, a batch each: bins (row, feature) of one byte, labels, weights (none: all 1), and margins (row, class).
_COLUMNS = ("bins", "y", "weight", "margins")
_STORED_SQL = "bins binary, y binary, weight binary, margins binary"


def _packed(bins: np.ndarray, y: np.ndarray, weight: np.ndarray | None, margins: np.ndarray) -> pa.RecordBatch:
    parts = (b"" if x is None else np.ascontiguousarray(x).tobytes() for x in (bins, y, weight, margins))
    return pa.record_batch([pa.array([x], pa.binary()) for x in parts], names=list(_COLUMNS))


def _bins_of(batch: pa.RecordBatch, cuts: list[list[float]]) -> np.ndarray:
    x = list_matrix(batch.column("x"))
    return np.column_stack([np.where(np.isnan(v), 0, np.searchsorted(c, v)) for v, c in zip(x.T, cuts)]).astype(np.uint8)


def _binned(cuts: list[list[float]], base: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _packed(_bins_of(batch, cuts), batch.column("y").to_numpy(), None, np.tile(np.array(base), (batch.num_rows, 1)))

    return run


def _keyed(cuts: list[list[float]]):
    """A value for each row's bins, and its label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = np.ascontiguousarray(_bins_of(batch, cuts))
                keys = pa.Array.from_buffers(pa.binary(len(cuts)), len(bins), [None, pa.py_buffer(bins)]).cast(pa.binary())
                yield pa.record_batch([keys, batch.column("y")], names=["bins", "y"])

    return run


def _weighted(n_features: int, base: list[float]):
    """Packed rows of counted ones (bins, y, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint8).reshape(-1, n_features)
                yield _packed(bins, batch.column("y").to_numpy(), batch.column("n").to_numpy().astype(np.float64), np.tile(np.array(base), (len(bins), 1)))

    return run


def _unpacked(batches: Iterator[pa.RecordBatch], n_features: int, n_trees: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]]:
    """(bins, labels, weights, margins) of each packed row, as views of its batch."""
    for batch in batches:
        columns = [batch.column(c) for c in _COLUMNS]
        for i in range(batch.num_rows):
            bins, y, weight, margins = (c[i].as_buffer() for c in columns)
            yield (np.frombuffer(bins, dtype=np.uint8).reshape(-1, n_features), np.frombuffer(y), np.frombuffer(weight) if weight.size else None,
                   np.frombuffer(margins).reshape(-1, n_trees))


def _advanced(n_features: int, n_trees: int, trees: list[Tree]):
    """The packed rows with the margins that a round's trees add."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = [(tree.on_bins(), np.array(tree.value)) for tree in trees]
        for bins, y, weight, margins in _unpacked(batches, n_features, n_trees):
            yield _packed(bins, y, weight, np.column_stack([margins[:, k] + value[walk(bins)] for k, (walk, value) in enumerate(leaves)]))

    return run


_SUMS = "class bigint, node bigint, block bigint, sums binary"


def _histograms(task: str, n_features: int, n_trees: int, growing: list[Tree], open_nodes: list[list[int]]):
    """Per task the sums of (gradient, Hessian, rows) for the nodes still open."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(nodes), n_features, MAX_BINS, 3)) for nodes in open_nodes]
        places, walks = [], [tree.on_bins() for tree in growing]
        for tree, nodes in zip(growing, open_nodes):
            places.append(np.full(len(tree.feature), -1))
            places[-1][nodes] = np.arange(len(nodes))
        for bins, y, weight, margins in _unpacked(batches, n_features, n_trees):
            g, h = derivatives(task, margins, y)
            if weight is not None:
                g, h = g * weight[:, None], h * weight[:, None]
            columns = bins.T.astype(np.int64)
            for k, nodes in enumerate(open_nodes):
                if not nodes:
                    continue
                at = places[k][walks[k](bins)]
                inside = at >= 0
                every = bool(inside.all())
                b, weights = columns, [g[:, k], h[:, k], weight]
                if not every:
                    at, b, weights = at[inside], columns[:, inside], [g[inside, k], h[inside, k], None if weight is None else weight[inside]]
                for f in range(n_features):
                    cell = at * MAX_BINS + b[f]
                    for i, w in enumerate(weights):
                        sums[k][:, f, :, i] += np.bincount(cell, w, minlength=len(nodes) * MAX_BINS).reshape(len(nodes), MAX_BINS)
        rows = [(k, node, at, sums[k][i, at:at + BLOCK_FEATURES].tobytes()) for k, nodes in enumerate(open_nodes) for i, node in enumerate(nodes)
                for at in range(0, n_features, BLOCK_FEATURES)]
        if rows:
            yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=["class", "node", "block", "sums"])

    return run


_SPLITS = "class bigint, node bigint, feature bigint, cut bigint, gain double, left array<double>, whole array<double>"


def best_split(sums: np.ndarray, p: BoostParams) -> tuple[float, int, int, np.ndarray, np.ndarray]:
    """(gain, feature, bin, sums left, sums of the node) of sums (feature, bin, [gradient, Hessian, rows]):
    the largest gain, ties by the first feature and bin; gain 0 if nothing may be split."""
    low = np.cumsum(sums, axis=1)
    whole = low[:, -1:, :]
    high = whole - low
    score = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1] + p.reg_lambda, 1e-300)
    gain = score(low) + score(high) - score(whole)
    allowed = whole[..., 2] >= p.min_samples_split
    for side in (low, high):
        allowed = allowed & (side[..., 2] >= max(1, p.min_samples_leaf)) & (side[..., 1] >= p.min_hessian)
    gain = np.where(allowed, gain, 0.0)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[f, b]), int(f), int(b), low[f, b], whole[0, 0]


def _split_of(p: BoostParams):
    def run(group: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(b) for b in group.column("sums").to_pylist()).reshape(-1, MAX_BINS, 3)
        gain, f, b, left, whole = best_split(sums, p)
        block = group.column("block")[0].as_py()
        return pa.table({"class": group.column("class").slice(0, 1), "node": group.column("node").slice(0, 1), "feature": [block + f], "cut": [b],
                         "gain": [gain], "left": [left.tolist()], "whole": [whole.tolist()]})

    return run


def fit_boosted(train: DataFrame, task: str, params: BoostParams = BoostParams(), n_classes: int = 2, features: str | Column = "features",
                label: str | Column = "label") -> Boosted:
    """Fit boosted trees on ``features array<double>`` and ``label`` (classes 0, 1, ...).

    Rows without a label or features take no part; a missing value (NaN) goes left at every split. Trees
    grow level by level; with ``max_leaves`` the splits of largest gain come first in each level.
    """
    spark = train.sparkSession
    column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = train.select(column(features).cast("array<double>").alias("x"), column(label).cast("double").alias("y"))
    rows = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    rows = rows.withColumn("x", F.transform("x", lambda v: F.coalesce(v, F.lit(float("nan")))))
    n_trees = 1 if task == "regression" or n_classes <= 2 else n_classes
    shares = [F.avg((F.col("y") == k).cast("double")) for k in range(max(2, n_classes))]
    n, n_features, mean, *shares = rows.agg(F.count("*"), F.max(F.size("x")), F.avg("y"), *shares).first()
    if mean is None:
        raise ValueError("no rows to fit on")
    if task == "regression":
        base = [mean]
    else:
        odds = np.log(np.clip(shares, 1e-9, 1))
        base = [float(odds[1] - odds[0])] if n_trees == 1 else odds.tolist()
    folder, packed, model = scratch_folder(spark), packed_session(spark), Boosted(task, max(2, n_classes) if task != "regression" else 1, base, [])

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.options(**PACKED_WRITES).parquet(f"{folder}/{name}")
        return packed.read.schema(df.schema).parquet(f"{folder}/{name}")

    tasks = learner_tasks(spark, n)
    if tasks:
        rows.repartition(tasks).write.parquet(f"{folder}/input")
        rows = spark.read.schema(rows.schema).parquet(f"{folder}/input")
    cuts = feature_cuts(rows, n_features, params.max_bins)
    if tasks and task != "regression":
        counted = rows.mapInArrow(_keyed(cuts), "bins binary, y double").groupBy("bins", "y").agg(F.count("*").alias("n"))
        data = stored(counted.mapInArrow(_weighted(n_features, base), _STORED_SQL), "rows-0")
    else:
        data = stored(rows.mapInArrow(_binned(cuts, base), _STORED_SQL), "rows-0")
    if tasks:
        drop_folder(spark, f"{folder}/input")
    for turn in range(params.n_estimators):
        trees = _grow(data, task, params, n_features, n_trees, cuts)
        model.rounds.append(trees)
        if all(t.feature == [-1] for t in trees):
            break
        if turn + 1 < params.n_estimators:
            data = stored(data.mapInArrow(_advanced(n_features, n_trees, trees), _STORED_SQL), f"rows-{turn + 1}")
            drop_folder(spark, f"{folder}/rows-{turn}")
    return model


def _grow(data: DataFrame, task: str, p: BoostParams, n_features: int, n_trees: int, cuts: list[list[float]]) -> list[Tree]:
    trees, open_nodes, depth = [Tree() for _ in range(n_trees)], [[0] for _ in range(n_trees)], 0
    n_leaves = [1] * n_trees

    def worth(sums) -> float:
        return -p.learning_rate * sums[0] / max(sums[1] + p.reg_lambda, 1e-300)

    while any(open_nodes) and (p.max_depth is None or depth < p.max_depth or depth == 0):
        sums = data.mapInArrow(_histograms(task, n_features, n_trees, trees, open_nodes), _SUMS)
        found: dict[tuple[int, int], object] = {}
        for r in sums.groupBy("class", "node", "block").applyInArrow(_split_of(p), _SPLITS).collect():
            old = found.get((r["class"], r["node"]))
            if old is None or (-r["gain"], r["feature"]) < (-old["gain"], old["feature"]):
                found[r["class"], r["node"]] = r
        open_nodes = [[] for _ in range(n_trees)]
        for (k, node), r in sorted(found.items(), key=lambda x: (-x[1]["gain"], x[0])):
            tree = trees[k]
            tree.value[node] = worth(r["whole"])
            if r["gain"] <= 1e-12 or p.max_depth == 0 or (p.max_leaves is not None and n_leaves[k] >= p.max_leaves):
                continue
            pair = tree.split(node, r["feature"], r["cut"], cuts[r["feature"]][r["cut"]])
            right = [w - v for w, v in zip(r["whole"], r["left"])]
            tree.value[pair[0]], tree.value[pair[1]] = worth(r["left"]), worth(right)
            n_leaves[k] += 1
            open_nodes[k] += pair
        open_nodes = [sorted(nodes) for nodes in open_nodes]
        depth += 1
    return trees
