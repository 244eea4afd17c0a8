"""The fit of MLlib's multilayer perceptron (#95) on many rows.

Network (sigmoid layers, softmax on top), loss (mean log loss), first weights, optimiser (L-BFGS under the strong
Wolfe conditions), its number of iterations and tolerance are MLlib's, and so is the fitted model. Rows of equal features
and class are counted once and weigh their number. Rows are packed once; in a pass every task sums loss and gradient over its rows by matrix products on blocks of many rows. Weights
and gradients are all that reaches the driver, whatever the rows. MLlib means over blocks, here each row counts alike.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Estimator
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.columns import list_matrix
from tidepool.operators.epochs import ADD_WAYS
from tidepool.session import PACKED_WRITES, drop_folder, learner_tasks, packed_session, scratch_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows whose layers are held at once, so that they stay in a core's cache.
BLOCK_ROWS = 1024
# A stored row is a batch of rows: features (feature, row), classes and weights (none: all 1).
_PACKED = "x binary, y binary, weight binary"
_SUMS, _NAMES = "n bigint, loss double, gradient binary", ["n", "loss", "gradient"]


def _packed(n_features: int, n_classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if batch.column("x").null_count or batch.column("y").null_count:
                raise ValueError("features and classes must not be null")
            x, y = list_matrix(batch.column("x")), batch.column("y").to_numpy()
            if x.shape[1] != n_features or not np.isfinite(x).all():
                raise ValueError(f"features must be {n_features} finite numbers")
            if not (np.isin(y, np.arange(n_classes))).all():
                raise ValueError(f"classes must be whole numbers in 0..{n_classes - 1}")
            n = batch.column("n").to_numpy()
            weight = b"" if (n == 1).all() else n.astype(np.float64).tobytes()
            yield pa.record_batch([pa.array([v], pa.binary()) for v in (np.ascontiguousarray(x.T).tobytes(), y.astype(np.int64).tobytes(), weight)],
                                  names=["x", "y", "weight"])

    return run


def layers_of(flat: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights (output, input), bias) of each layer, in MLlib's order of a model's weights."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((flat[at:at + a * b].reshape(a, b).T, flat[at + a * b:at + a * b + b, None]))
        at += a * b + b
    return out


def loss_and_gradient(flat: np.ndarray, sizes: list[int], x: np.ndarray, y: np.ndarray, room: list[tuple[np.ndarray, np.ndarray]],
                      weight: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Sums of the log loss and of its derivative by each weight over rows ``x`` (feature, row) of classes ``y``, each as often
    as its ``weight`` says.
    ``room`` holds two arrays (unit, row) for each hidden layer, so that no block asks for memory anew."""
    layers, values, n = layers_of(flat, sizes), [x], len(y)
    for (w, b), (held, _) in zip(layers, room):
        z = np.matmul(-w, values[-1], out=held[:, :n])
        z -= b
        with np.errstate(over="ignore"):
            np.exp(z, out=z)
        z += 1.0
        values.append(np.reciprocal(z, out=z))
    delta = layers[-1][0] @ values[-1] + layers[-1][1]
    delta -= delta.max(axis=0)
    at = (y, np.arange(n))
    loss = -delta[at]
    np.exp(delta, out=delta)
    total = delta.sum(axis=0)
    loss += np.log(total)
    delta /= total
    delta[at] -= 1.0
    if weight is not None:
        loss *= weight
        delta *= weight
    gradient = []
    for i in range(len(layers) - 1, -1, -1):
        below = values[i]
        gradient[:0] = [(below @ delta.T).ravel(), delta.sum(axis=1)]
        if i:
            delta = np.matmul(layers[i][0].T, delta, out=room[i - 1][1][:, :n])
            delta *= below
            np.subtract(1.0, below, out=below)
            delta *= below
    return float(loss.sum()), np.concatenate(gradient)


def _task_sums(flat: np.ndarray, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, total = 0, 0.0, np.zeros(len(flat))
        room = [(np.empty((h, BLOCK_ROWS)), np.empty((h, BLOCK_ROWS))) for h in sizes[1:-1]]
        for batch in batches:
            for packed in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "weight"))):
                x, y = np.frombuffer(packed[0]).reshape(sizes[0], -1), np.frombuffer(packed[1], dtype=np.int64)
                weight = np.frombuffer(packed[2]) if packed[2] else None
                for at in range(0, len(y), BLOCK_ROWS):
                    some = slice(at, at + BLOCK_ROWS)
                    more, gradient = loss_and_gradient(flat, sizes, x[:, some], y[some], room, None if weight is None else weight[some])
                    loss += more
                    total += gradient
                n += len(y) if weight is None else int(weight.sum())
        yield pa.record_batch([pa.array([n]), pa.array([loss]), pa.array([total.tobytes()], pa.binary())], names=_NAMES)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, loss, total = 0, 0.0, 0.0
    for batch in batches:
        for m, more, g in zip(*(batch.column(c).to_pylist() for c in _NAMES)):
            n, loss, total = n + m, loss + more, total + np.frombuffer(g)
    if n:
        yield pa.record_batch([pa.array([n]), pa.array([loss]), pa.array([total.tobytes()], pa.binary())], names=_NAMES)


def mean_loss(rows: DataFrame, flat: np.ndarray, sizes: list[int]) -> tuple[float, np.ndarray]:
    """Mean loss and gradient over all packed rows: tasks' sums are added in up to ADD_WAYS tasks, then here."""
    sums = rows.mapInArrow(_task_sums(flat, sizes), _SUMS)
    if rows.sparkSession.sparkContext.defaultParallelism > ADD_WAYS:
        sums = sums.repartition(ADD_WAYS).mapInArrow(_added, _SUMS)
    found = sums.collect()
    n = sum(r["n"] for r in found)
    return sum(r["loss"] for r in found) / n, sum(np.frombuffer(r["gradient"]) for r in found) / n


Point = tuple[float, float, float, np.ndarray, np.ndarray]  # step, value, slope, place, gradient


def _between(a: Point, b: Point) -> float:
    """The step of the least value of the cubic through two points, away from both."""
    (s, v, d), (t, w, e) = sorted((a[:3], b[:3]))
    d1 = d + e - 3 * (v - w) / (s - t)
    d2 = np.sqrt(max(d1 * d1 - d * e, 0.0))
    below = e - d + 2 * d2
    step = t - (t - s) * (e + d2 - d1) / below if below else (s + t) / 2
    return min(max(step, s + 0.1 * (t - s)), s + 0.9 * (t - s))


def _line_search(along: Callable[[float], Point], start: Point, step: float, trials: int = 10) -> Point | None:
    """A point that meets the strong Wolfe conditions (1e-4, 0.9); None if no trial does."""
    _, value, slope, _, _ = start
    low, high = start, None
    for i in range(trials):
        at = along(step)
        if not np.isfinite(at[1]):
            step /= 2
            continue
        if at[1] > value + 1e-4 * step * slope or i and at[1] >= low[1]:
            high = at
            break
        if abs(at[2]) <= 0.9 * abs(slope):
            return at
        if at[2] >= 0:
            low, high = at, low
            break
        low, step = at, step * 1.5
    for _ in range(trials if high else 0):
        at = along(_between(low, high))
        if not at[1] <= value + 1e-4 * at[0] * slope or at[1] >= low[1]:
            high = at
        else:
            if abs(at[2]) <= 0.9 * abs(slope):
                return at
            if at[2] * (high[0] - low[0]) >= 0:
                high = low
            low = at
    return None


def minimise(function: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, iterations: int, tolerance: float,
             memory: int = 10, recent: int = 20) -> np.ndarray:
    """L-BFGS as MLlib runs it: ends after so many ``iterations``, when the gradient is small against the value, when
    the ``recent`` values differ little against the first, or when the search fails twice in a row."""
    value, gradient = function(x)
    first, values, moves, failed, done = value, [np.inf], [], False, 0
    while done < iterations and np.linalg.norm(gradient) > max(tolerance * abs(value), 1e-8) and value - max(values) < -tolerance * first:
        direction, kept = -gradient, []
        for s, y in reversed(moves):
            kept.append(s @ direction / (s @ y))
            direction = direction - kept[-1] * y
        if moves:
            s, y = moves[-1]
            direction = direction * (s @ y / (y @ y))
        for (s, y), a in zip(moves, reversed(kept)):
            direction = direction + (a - y @ direction / (s @ y)) * s

        def along(t: float) -> Point:
            place = x + t * direction
            v, g = function(place)
            return t, v, float(g @ direction), place, g

        slope = float(gradient @ direction)
        found = _line_search(along, (0.0, value, slope, x, gradient), 1.0 if done else 1 / np.linalg.norm(direction)) if slope < 0 else None
        if found is None:
            if failed:
                break
            failed, moves = True, []
            continue
        moves, failed, done = [*moves, (found[3] - x, found[4] - gradient)][-memory:], False, done + 1
        _, value, _, x, gradient = found
        values = [*values, value][-recent:]
    return x


class Perceptron(Estimator):
    """Fits what the MLlib classifier ``est`` describes: different rows are counted and dealt to all cores."""

    def __init__(self, est: MultilayerPerceptronClassifier):
        super().__init__()
        self.est = est

    def _fit(self, dataset: DataFrame):
        est, spark = self.est, dataset.sparkSession
        features, label, sizes = est.getFeaturesCol(), est.getLabelCol(), list(est.getLayers())
        folder = scratch_folder(spark)
        rows = dataset.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")).groupBy("x", "y").agg(F.count("*").alias("n"))
        rows.write.parquet(f"{folder}/counted")
        rows = spark.read.schema(rows.schema).parquet(f"{folder}/counted")
        tasks = learner_tasks(spark, rows.count()) or spark.sparkContext.defaultParallelism
        rows.repartition(tasks).mapInArrow(_packed(sizes[0], sizes[-1]), _PACKED).write.options(**PACKED_WRITES).parquet(f"{folder}/rows")
        drop_folder(spark, f"{folder}/counted")
        rows = packed_session(spark).read.schema(_PACKED).parquet(f"{folder}/rows")
        # no iterations on one row: MLlib's first weights, or its model of given ones
        one = spark.createDataFrame([(Vectors.dense([0.0] * sizes[0]), 0.0)], [features, label])
        start = est.copy({est.maxIter: 0}).fit(one).weights.toArray()
        weights = minimise(lambda flat: mean_loss(rows, flat, sizes), start, est.getMaxIter(), est.getTol())
        drop_folder(spark, folder)
        model = est.copy({est.maxIter: 0, est.initialWeights: Vectors.dense(weights)}).fit(one)
        model.set(model.maxIter, est.getMaxIter())
        return model
