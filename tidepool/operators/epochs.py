"""A learner in epochs with a holdout (#95, #112, #113): a small fully connected network.

Rows are stored packed in ``steps`` parts, many dealt evenly to all cores. A step is a pass over one part: every task sums the loss's gradient
over its rows, the sums are added up, and one synchronous update follows, so the result does not depend
on how rows are spread. After each epoch the loss on the holdout decides: the best weights are kept, and
``patience`` epochs without a better one end the training. The history has a row for each epoch. Weights and
gradients are all that reaches the driver, whatever the rows.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions.columns import list_matrix
from tidepool.operators.split import random_split
from tidepool.session import drop_folder, learner_tasks, scratch_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Weights = list[np.ndarray]
HISTORY = "epoch int, train_loss double, val_loss double, train_metric double, val_metric double, seconds double"


@dataclass
class Network:
    """Layers of weights and biases, rectified between layers; inputs are standardised first."""

    task: str
    weights: Weights
    mean: np.ndarray
    scale: np.ndarray
    history: list[tuple] = field(default_factory=list)  # a row for each epoch, see HISTORY
    best_epoch: int = 0

    def outputs(self, x: np.ndarray) -> np.ndarray:
        return forward(self.weights, (x - self.mean) * self.scale)[-1]

    def predict(self, df: DataFrame, features: str | Column = "features") -> DataFrame:
        """``df`` with ``yhat``: a number, or the class with the largest ``probability``."""
        model = self

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def scores(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            out = model.outputs(np.stack(x.to_list()).astype(np.float64))
            return pd.Series(list(out if model.task == "regression" else softmax(out)), dtype=object)

        x = F.col(features) if isinstance(features, str) else features
        out = df.withColumn("probability", scores(x.cast("array<double>")))
        if self.task == "regression":
            return out.withColumn("yhat", F.element_at("probability", 1)).drop("probability")
        return out.withColumn("yhat", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))

    def history_rows(self, df: DataFrame) -> DataFrame:
        """A row for each epoch that ran; the metric is R² or accuracy."""
        return df.sparkSession.createDataFrame(self.history, HISTORY)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def forward(weights: Weights, x: np.ndarray) -> list[np.ndarray]:
    """The values of every layer, inputs first."""
    layers = [x]
    for i in range(0, len(weights), 2):
        z = layers[-1] @ weights[i] + weights[i + 1]
        layers.append(z if i == len(weights) - 2 else np.maximum(z, 0.0))
    return layers


def output_loss(task: str, out: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, int]:
    """The loss of outputs, its derivative by each and the rows of which the largest output is the class."""
    if task == "regression":
        delta = out - y[:, None]
        return float((delta ** 2).sum() / 2), delta, 0
    delta, at = softmax(out), (np.arange(len(y)), y.astype(np.int64))
    hits, loss = int((delta.argmax(axis=1) == at[1]).sum()), float(-np.log(np.maximum(delta[at], 1e-300)).sum())
    delta[at] -= 1.0
    return loss, delta, hits


def loss_and_gradient(task: str, weights: Weights, x: np.ndarray, y: np.ndarray) -> tuple[float, Weights, int]:
    """Sums over the rows: half the squared error, or the log loss, its derivative by each weight, and the
    rows of which the largest output is the class."""
    layers = forward(weights, x)
    loss, delta, hits = output_loss(task, layers[-1], y)
    gradient: Weights = []
    for i in range(len(weights) - 2, -1, -2):
        below = layers[i // 2]
        gradient[:0] = [below.T @ delta, delta.sum(axis=0)]
        if i:
            delta = (delta @ weights[i].T) * (below > 0)
    return loss, gradient, hits


def _flat(weights: Weights) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights])


def _shaped(flat: np.ndarray, like: Weights) -> Weights:
    ends = np.cumsum([w.size for w in like])
    return [flat[e - w.size:e].reshape(w.shape) for w, e in zip(like, ends)]


_SUMS = "n bigint, hits bigint, loss double, gradient binary"
_NAMES = ["n", "hits", "loss", "gradient"]


# Stored rows are packed, a batch of one part each: features (row, feature) and labels.
_PACKED = "part int, x binary, y binary"
BLOCK_ROWS = 2048  # rows whose layers are held at once, so that they stay in a core's cache


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y, part = list_matrix(batch.column("x")), batch.column("y").to_numpy(), batch.column("part").to_numpy()
            for p in np.unique(part):
                own = part == p
                yield pa.record_batch([pa.array([p], pa.int32()), *(pa.array([np.ascontiguousarray(v[own], dtype=np.float64).tobytes()], pa.binary()) for v in (x, y))],
                                      names=["part", "x", "y"])


def _task_sums(task: str, weights: Weights, mean: np.ndarray, scale: np.ndarray, learning: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, hits, loss, total = 0, 0, 0.0, np.zeros(sum(w.size for w in weights))
        for batch in batches:
            for packed in zip(*(batch.column(c).to_pylist() for c in ("x", "y"))):
                rows, labels = np.frombuffer(packed[0]).reshape(-1, len(mean)), np.frombuffer(packed[1])
                for at in range(0, len(rows), BLOCK_ROWS):
                    x, y = (rows[at:at + BLOCK_ROWS] - mean) * scale, labels[at:at + BLOCK_ROWS]
                    if learning:
                        more, gradient, right = loss_and_gradient(task, weights, x, y)
                        total += _flat(gradient)
                    else:
                        more, _, right = output_loss(task, forward(weights, x)[-1], y)
                    n, hits, loss = n + len(y), hits + right, loss + more
        yield pa.record_batch([pa.array([n]), pa.array([hits]), pa.array([loss]), pa.array([total.tobytes()], pa.binary())], names=_NAMES)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, hits, loss, total = 0, 0, 0.0, 0.0
    for batch in batches:
        for m, right, more, g in zip(*(batch.column(c).to_pylist() for c in _NAMES)):
            n, hits, loss, total = n + m, hits + right, loss + more, total + np.frombuffer(g)
    if n:
        yield pa.record_batch([pa.array([n]), pa.array([hits]), pa.array([loss]), pa.array([total.tobytes()], pa.binary())], names=_NAMES)


# Tasks that add up sums; features beyond which a row counts as several when rows are dealt to tasks.
ADD_WAYS, WIDE = 64, 32


def _summed(rows: DataFrame, net: Network, learning: bool = True) -> tuple[int, int, float, np.ndarray]:
    """(rows, hits, loss, gradient) over all packed rows: tasks' sums are added in up to ADD_WAYS tasks, then
    here. The gradient is zero without ``learning``."""
    sums = rows.mapInArrow(_task_sums(net.task, net.weights, net.mean, net.scale, learning), _SUMS)
    if rows.sparkSession.sparkContext.defaultParallelism > ADD_WAYS:
        sums = sums.repartition(ADD_WAYS).mapInArrow(_added, _SUMS)
    found = sums.collect()
    return sum(r["n"] for r in found), sum(r["hits"] for r in found), sum(r["loss"] for r in found), sum((np.frombuffer(r["gradient"]) for r in found), np.zeros(sum(w.size for w in net.weights)))


def fit_epochs(df: DataFrame, keys: Sequence[str], task: str, hidden: Sequence[int] = (64, 32), n_classes: int = 2, epochs: int = 20, steps: int = 1,
               rate: float = 0.01, patience: int | None = None, holdout: float = 0.2, seed: int = 42, features: str = "features",
               label: str = "label") -> Network:
    """Train on ``features`` (windows are flattened) and ``label``, with a random ``holdout`` share by ``keys``.

    ``steps`` updates an epoch, each from its own part of the rows (Adam, its rate falling from ``rate`` to
    zero over the epochs); ``patience`` defaults to half the epochs, at least one. Without hidden layers the model is linear, and the loss convex.
    """
    nested = df.select(features).dtypes[0][1].startswith("array<array")
    x = (F.flatten(features) if nested else F.col(features)).cast("array<double>")
    rows = df.withColumns({"_tp_x": x, "_tp_y": F.col(label).cast("double")}).where("_tp_x is not null and _tp_y is not null")
    train, held = random_split(rows, list(keys), holdout, seed)
    folder, spark = scratch_folder(df.sparkSession), df.sparkSession
    part = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(steps)).cast("int").alias("part")

    def stored(side: DataFrame, name: str, *by: str) -> DataFrame:
        side.write.partitionBy(*by).parquet(f"{folder}/{name}")
        return spark.read.schema(side.schema).parquet(f"{folder}/{name}")

    train, held = (stored(side.select(F.col("_tp_x").alias("x"), F.col("_tp_y").alias("y"), part), f"{name}-rows") for name, side in (("train", train), ("held", held)))
    width = train.agg(F.max(F.size("x"))).first()[0]
    if width is None:
        raise ValueError("no rows to fit on")
    values = [F.get("x", F.lit(i)) for i in range(width)]
    moments = train.agg(*[F.avg(v) for v in values], *[F.stddev_pop(v) for v in values]).first()
    mean, std = np.array(moments[:width], dtype=np.float64), np.array(moments[width:], dtype=np.float64)
    sizes, rnd = [width, *hidden, 1 if task == "regression" else max(2, n_classes)], np.random.default_rng(seed)
    weights: Weights = []
    for a, b in zip(sizes, sizes[1:]):
        weights += [rnd.normal(size=(a, b)) * np.sqrt(2 / a), np.zeros(b)]
    spread = [side.agg(F.coalesce(F.var_pop("y"), F.lit(0.0)), F.coalesce(F.avg("y"), F.lit(0.0)), F.count("*")).first() for side in (train, held)]
    packed = []
    for name, side, count in zip(("train", "held"), (train, held), (r[2] for r in spread)):
        tasks = learner_tasks(spark, count * -(-width // WIDE))
        side = side.repartition(tasks) if tasks else side
        packed.append(stored(side.mapInArrow(_packed, _PACKED), name, "part"))
        drop_folder(spark, f"{folder}/{name}-rows")
    train, held = packed
    if task == "regression":
        weights[-1] += spread[0][1]  # the outputs begin at the labels' mean

    def metric(n: int, hits: int, loss: float, variance: float) -> float:
        if not n:
            return float("nan")
        return hits / n if task != "regression" else 1 - 2 * loss / n / variance if variance else float("nan")

    net = Network(task, weights, mean, np.divide(1.0, std, out=np.zeros(width), where=std > 0))
    patience = max(1, epochs // 2) if patience is None else patience
    first, second, updates, best, best_loss = 0.0, 0.0, 0, [w.copy() for w in weights], np.inf
    for epoch in range(1, epochs + 1):
        seen, right, lost, began = 0, 0, 0.0, time.monotonic()
        for step in range(steps):
            n, hits, loss, gradient = _summed(train.where(F.col("part") == step).select("x", "y"), net)
            if not n:
                continue
            seen, right, lost, updates, g = seen + n, right + hits, lost + loss, updates + 1, gradient / n
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            move = rate * (1 - (epoch - 1) / epochs) * (first / (1 - 0.9 ** updates)) / (np.sqrt(second / (1 - 0.999 ** updates)) + 1e-8)
            net.weights = _shaped(_flat(net.weights) - move, net.weights)
        n, hits, loss, _ = _summed(held.select("x", "y"), net, learning=False)
        held_loss = loss / n if n else lost / max(1, seen)
        net.history.append((epoch, lost / max(1, seen), held_loss, metric(seen, right, lost, spread[0][0]), metric(n, hits, loss, spread[1][0]),
                            time.monotonic() - began))
        if held_loss < best_loss:
            best, best_loss, net.best_epoch = [w.copy() for w in net.weights], held_loss, epoch
        elif epoch - net.best_epoch >= patience:
            break
    net.weights = best
    return net


def cross_validate_epochs(df: DataFrame, keys: Sequence[str], task: str, k: int = 5, **options) -> DataFrame:
    """(fold, score): R² or accuracy on k shuffled folds; a fold's model is trained on the other rows, of
    which a fifth is the holdout that ends its training."""
    from tidepool.operators.evaluate import accuracy, regression_metrics
    from tidepool.operators.split import kfold

    folded, scores = kfold(df, list(keys), k), []
    label, features = options.get("label", "label"), options.get("features", "features")
    flat = F.flatten(features) if df.select(features).dtypes[0][1].startswith("array<array") else F.col(features)
    for f in range(k):
        net = fit_epochs(folded.where(F.col("fold") != f).drop("fold"), keys, task, **options)
        scored = net.predict(folded.where(F.col("fold") == f), flat)
        found = accuracy(scored, label, "yhat") if task == "classification" else regression_metrics(scored, label, "yhat").select("r2")
        scores.append((f, float(found.first()[0])))
    return df.sparkSession.createDataFrame(scores, "fold int, score double")
