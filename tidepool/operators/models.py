"""Model fitting and scoring (#91-#100, #113) and the model registry.

Trees, forests, ``gbt_*`` (multi-class through one-vs-rest) and ``mlp_classifier`` are MLlib's. ``xgboost_*``
and ``lightgbm_*`` are second-order boosting (``operators.boosting``) with those libraries' defaults. Feature
vectors come from the ``features array<double>`` column built by ``operators.features``.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.columns import list_matrix
from tidepool.operators.boosting import Boosted, BoostParams, feature_cuts, fit_boosted
from tidepool.operators.forest import Forest
from tidepool.operators.perceptron import Perceptron
from tidepool.operators.split import kfold
from tidepool.session import learner_tasks

# the ridge sums run in Python workers: ship this module's code by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The deepest tree that MLlib can hold. Depth None, unbounded elsewhere, is DEFAULT_DEPTH:
# MLlib keeps all trees on the driver, so the depth of a forest is bounded unless the caller asks for more.
MAX_TREE_DEPTH, DEFAULT_DEPTH = 30, 10
SEED = 42
# MLlib's bins of a feature, and the column that holds them.
TREE_BINS, BINS_COLUMN = 32, "_tp_bins"


def _depth(v) -> int:
    depth = DEFAULT_DEPTH if v is None else int(v)
    if not 0 <= depth <= MAX_TREE_DEPTH:
        raise ValueError(f"max_depth must lie in 0..{MAX_TREE_DEPTH}, not {depth}")
    return depth


def _leaf(params: dict) -> int:
    leaf = int(params.get("min_samples_leaf", 1))
    split = int(params.get("min_samples_split", 2))
    # min_samples_split has no MLlib counterpart: a split needs two children of >= leaf rows
    return max(leaf, math.ceil(split / 2))


def _rf_reg(p):
    return RandomForestRegressor(numTrees=int(p.get("n_estimators", 100)), maxDepth=_depth(p.get("max_depth")),
                                 minInstancesPerNode=_leaf(p), cacheNodeIds=True, seed=SEED)


def _rf_clf(p):
    return RandomForestClassifier(numTrees=int(p.get("n_estimators", 100)), maxDepth=_depth(p.get("max_depth")),
                                  minInstancesPerNode=_leaf(p), cacheNodeIds=True, seed=SEED)


def _dt_reg(p):
    return DecisionTreeRegressor(maxDepth=_depth(p.get("max_depth")), minInstancesPerNode=_leaf(p), seed=SEED)


def _dt_clf(p):
    return DecisionTreeClassifier(maxDepth=_depth(p.get("max_depth")), minInstancesPerNode=_leaf(p), seed=SEED)


def _gbt_reg(p):
    return GBTRegressor(maxIter=int(p.get("n_estimators", 100)), maxDepth=_depth(p.get("max_depth", 6)), minInstancesPerNode=_leaf(p),
                        stepSize=float(p.get("learning_rate", 0.1)), seed=SEED)


def _gbt_clf(p, n_classes: int = 2):
    base = GBTClassifier(maxIter=int(p.get("n_estimators", 100)), maxDepth=_depth(p.get("max_depth", 6)), minInstancesPerNode=_leaf(p),
                         stepSize=float(p.get("learning_rate", 0.1)), seed=SEED)
    return base if n_classes <= 2 else OneVsRest(classifier=base)


def _mlp_clf(p, n_features: int, n_classes: int):
    hidden = p.get("hidden_layers", "64,32")
    if isinstance(hidden, (list, tuple)):
        layers = [int(x) for x in hidden]
    else:  # "64,32", "64" or a bare int after coercion
        layers = [int(x) for x in str(hidden).replace(" ", "").split(",") if x]
    return MultilayerPerceptronClassifier(layers=[n_features, *layers, n_classes], maxIter=int(p.get("epochs", 100)),
                                          seed=SEED)


@dataclass(frozen=True)
class ModelSpec:
    name: str
    task: str  # "regression" | "classification"
    build: Callable
    defaults: dict = field(default_factory=dict)


# Registry names and the task each model serves.
REGISTRY: dict[str, ModelSpec] = {
    "random_forest_regressor": ModelSpec("random_forest_regressor", "regression", _rf_reg, {"n_estimators": 100}),
    "random_forest_classifier": ModelSpec("random_forest_classifier", "classification", _rf_clf, {"n_estimators": 100}),
    "decision_tree_regressor": ModelSpec("decision_tree_regressor", "regression", _dt_reg),
    "decision_tree_classifier": ModelSpec("decision_tree_classifier", "classification", _dt_clf),
    "gbt_regressor": ModelSpec("gbt_regressor", "regression", _gbt_reg, {"n_estimators": 100, "max_depth": 6}),
    "gbt_classifier": ModelSpec("gbt_classifier", "classification", _gbt_clf, {"n_estimators": 100, "max_depth": 6}),
    "linear_forecast": ModelSpec("linear_forecast", "regression",
                                 lambda p: LinearRegression(regParam=float(p.get("reg", 1e-3)), elasticNetParam=0.0)),
    "mlp_classifier": ModelSpec("mlp_classifier", "classification", _mlp_clf),
}


# The learners that read their rows in many passes.
ITERATIVE = {name for name in REGISTRY if name.startswith(("random_forest", "gbt", "mlp"))}

# The defaults of two boosting libraries (learning rate, depth or leaves, regularisation).
_LEVELS = {"learning_rate": 0.3, "max_depth": 6, "min_hessian": 1.0, "reg_lambda": 1.0}
_LEAVES = {"learning_rate": 0.1, "max_depth": None, "max_leaves": 31, "min_hessian": 1e-3, "reg_lambda": 0.0}
BOOSTERS: dict[str, tuple[str, dict]] = {
    "xgboost_regressor": ("regression", _LEVELS), "xgboost_classifier": ("classification", _LEVELS),
    "lightgbm_regressor": ("regression", _LEAVES), "lightgbm_classifier": ("classification", _LEAVES),
}


def boost_params(name: str, params: dict | None) -> BoostParams:
    """A booster's parameters over its library's defaults; no depth given means the library's own."""
    given = {k: v for k, v in coerce_params(params or {}, name).items() if v is not None}
    return BoostParams(**{**BOOSTERS[name][1], **given})


def get_spec(name: str) -> ModelSpec:
    if name not in REGISTRY:
        raise ValueError(f"no model is called {name!r}; there are {', '.join(sorted([*REGISTRY, *BOOSTERS]))}")
    return REGISTRY[name]


# The parameters that each kind of model takes, with their types and defaults.
_TREE = {"max_depth": (int, None), "min_samples_split": (int, 2), "min_samples_leaf": (int, 1)}
_FOREST = {"n_estimators": (int, 100), **_TREE}
_BOOST = {**_FOREST, "learning_rate": (float, 0.1)}
PARAMS: dict[str, dict[str, tuple[type, object]]] = {
    "random_forest_regressor": _FOREST, "random_forest_classifier": _FOREST,
    "decision_tree_regressor": _TREE, "decision_tree_classifier": _TREE,
    "gbt_regressor": _BOOST, "gbt_classifier": _BOOST, **{name: _BOOST for name in BOOSTERS},
    "linear_forecast": {"reg": (float, 1e-3)},
    "mlp_classifier": {"hidden_layers": (str, "64,32"), "epochs": (int, 100)},
}


def coerce_params(raw: dict, name: str) -> dict:
    """The parameters of model ``name``, typed by its schema; texts are converted, ``None`` and the empty
    text mean unbounded. A name that the schema lacks, or a value of another type, is an error."""
    schema, out = PARAMS[name], {}
    for k, v in raw.items():
        if k not in schema:
            raise ValueError(f"{name} has no parameter {k!r}; it has {', '.join(schema)}")
        kind = schema[k][0]
        if isinstance(v, str) and kind is not str:
            v = None if v.strip().lower() in ("", "none", "null") else v.strip()
        if v is None or isinstance(v, (list, tuple)) and kind is str:
            out[k] = v
            continue
        try:
            out[k] = kind(v)
        except (TypeError, ValueError):
            raise ValueError(f"{name}: {k} must be of type {kind.__name__}, not {v!r}") from None
        if kind is int and isinstance(v, float) and v != out[k]:
            raise ValueError(f"{name}: {k} must be a whole number, not {v!r}")
    return out


def with_vector(df: DataFrame, features: str = "features", out: str = "fvec") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(features)))


def build_estimator(name: str, params: dict | None, task_type: str, n_features: int = 0, n_classes: int = 2,
                    label: str = "label"):
    spec = get_spec(name)
    if spec.task != task_type:
        raise ValueError(f"{name} solves {spec.task}, not {task_type}")
    p = {**spec.defaults, **coerce_params(params or {}, name)}
    if spec.build is _mlp_clf:
        est = spec.build(p, n_features, n_classes)
    elif spec.build is _gbt_clf:
        est = spec.build(p, n_classes)
    else:
        est = spec.build(p)
    return est.setFeaturesCol("fvec").setLabelCol(label).setPredictionCol("prediction")


def dealt(df: DataFrame) -> DataFrame:
    """Many rows dealt evenly to all cores, few as they are: a file of one row group is read by one task."""
    tasks = learner_tasks(df.sparkSession, df.count())
    return df.repartition(tasks) if tasks else df


def with_values(df: DataFrame, names: list[str]) -> DataFrame:
    x = vector_to_array("fvec")
    return df.withColumns({c: F.get(x, F.lit(i)) for i, c in enumerate(names)})


def _fit_in_bins(data: DataFrame, est, label: str, n: int, leaf: int) -> PipelineModel:
    """Fit trees without random draws on weighted rows: one for each label and combination of bins, as rows that lie
    in the same bins are alike to every tree. Of numbers the mean label of a combination stands for its rows: boosted
    squared errors choose splits and leaves by sums of labels alone. The bins (MLlib's own number a feature) are cut once
    over all rows, and are the first stage of the model. ``leaf`` counts rows, so it becomes a share of the weight."""
    width = data.select(F.size(vector_to_array("fvec")).alias("d")).first()["d"]
    cuts = feature_cuts(data.select(vector_to_array("fvec").alias("x")), width, TREE_BINS)
    values, bins = ([f"_tp_{kind}{i}" for i in range(width)] for kind in ("value", "bin"))
    # a bin ends with its cut, a Bucketizer's before it
    borders = [[-math.inf, *(float(np.nextafter(v, math.inf)) for v in c or [0.0]), math.inf] for c in cuts]
    buckets = Bucketizer(inputCols=values, outputCols=bins, splitsArray=borders, handleInvalid="keep")
    rows, weight = buckets.transform(with_values(data, values)), F.count("*").cast("double").alias("weight")
    if isinstance(est, GBTRegressor):
        # MLlib refuses NaN labels, and so rows without a label or whose features are not numbers
        odd = F.coalesce(F.exists(vector_to_array("fvec"), lambda v: F.isnan(v) | (F.abs(v) == math.inf)), F.lit(True))
        # a Bucketizer's columns are marked as categories, which MLlib would split as sets: sums are not marked
        rows = rows.groupBy(*[(F.col(b) + 0.0).alias(b) for b in bins]).agg(weight, F.avg(F.when(odd | F.col(label).isNull(), math.nan).otherwise(F.col(label))).alias(label))
    else:
        rows = rows.groupBy(*bins, label).agg(weight)
    trees = est.getClassifier() if isinstance(est, OneVsRest) else est
    trees.setMinInstancesPerNode(1)
    if leaf > 1:
        trees.setMinWeightFractionPerNode((leaf - 0.5) / n)
    est.setFeaturesCol(BINS_COLUMN).setWeightCol("weight")
    fitted = Pipeline(stages=[VectorAssembler(inputCols=bins, outputCol=BINS_COLUMN), est]).fit(rows)
    return PipelineModel([buckets, *fitted.stages])


def fit_model(train: DataFrame, name: str, params: dict | None = None, task_type: str = "regression",
              n_classes: int = 2, features: str = "features", label: str = "label", partitions: int | None = None) -> PipelineModel | Boosted:
    """Fit ``name`` on ``features array<double>`` → ``label`` (the task must match the model kind).

    Iterative learners run a job per iteration over every partition: ``partitions`` deals the training rows
    anew to so many, by default many rows are dealt to all cores (``session.learner_tasks``), few stay. MLlib's
    perceptron is then fitted by :class:`Perceptron`, its forests by :class:`Forest`.
    """
    if name in BOOSTERS:
        if BOOSTERS[name][0] != task_type:
            raise ValueError(f"{name} solves {BOOSTERS[name][0]}, not {task_type}")
        return fit_boosted(train.repartition(partitions) if partitions else train, task_type, boost_params(name, params), n_classes, features, label)
    n_features = len(train.select(features).first()[0]) if name == "mlp_classifier" else 0
    est = build_estimator(name, params, task_type, n_features, n_classes, label)
    data = with_vector(train, features).withColumn(label, F.col(label).cast("double"))
    if not partitions and name in ITERATIVE:
        data = data.select("fvec", label)
        n, leaf = data.count(), _leaf(coerce_params(params or {}, name))
        partitions = learner_tasks(train.sparkSession, n)
        if partitions and name.startswith("gbt") and leaf < n / 2:
            return _fit_in_bins(data, est, label, n, leaf)
        if partitions and name == "mlp_classifier":
            est = Perceptron(est)
        if partitions and name.startswith("random_forest"):
            est = Forest(est)
    return Pipeline(stages=[est]).fit(data.repartition(partitions) if partitions else data)


def predict(model: PipelineModel | Boosted, df: DataFrame, features: str = "features") -> DataFrame:
    """``yhat`` (and ``probability array<double>`` for probabilistic classifiers)."""
    if isinstance(model, Boosted):
        return model.predict(df, features)
    rows, spare = with_vector(df, features), ["fvec", "rawPrediction"]
    if isinstance(model.stages[0], Bucketizer):
        rows = with_values(rows, model.stages[0].getInputCols())
        spare += [*model.stages[0].getInputCols(), *model.stages[0].getOutputCols(), BINS_COLUMN]
    out = model.transform(rows)
    if "probability" in out.columns:
        out = out.withColumn("probability", vector_to_array("probability"))
    return out.withColumnRenamed("prediction", "yhat").drop(*spare)


@dataclass(frozen=True)
class Ridge:
    """Linear forecasts of all horizons: ``yhat = bias + weights · features``."""

    weights: np.ndarray  # horizon × feature
    bias: np.ndarray

    def predict(self, features: str | Column) -> Column:
        """``array<double>``, one forecast per horizon, for a whole batch in one matrix product."""
        weights, bias = self.weights, self.bias

        @F.pandas_udf("array<double>")
        def forecast(x: pd.Series) -> pd.Series:
            return pd.Series(list(np.stack(x.to_list()) @ weights.T + bias) if len(x) else [], dtype=object)

        return forecast(features)


@dataclass
class Moments:
    """Rows, means and centred products of columns z; merging keeps them centred, so that large offsets
    cost no digits."""

    n: float
    mean: np.ndarray
    products: np.ndarray  # sums of (z_i - mean_i)(z_j - mean_j), or some of its rows

    def merged(self, other: Moments, rows: slice = slice(None)) -> Moments:
        if not self.n or not other.n:
            return other if not self.n else self
        n, gap = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.products + other.products + np.outer(gap[rows], gap) * (self.n * other.n / n))


_MOMENTS = "fold bigint, i bigint, n double, mean binary, products binary"


def _moments(width: int):
    """Per task and fold: the moments of [x, y], a packed row for each row of the matrix."""

    def run(batches):
        sums: dict[int, Moments] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            fold = batch.column("fold").to_numpy()
            z = np.column_stack([list_matrix(batch.column(c)) for c in ("x", "y")])
            for f in np.unique(fold):
                part = z[fold == f]
                mean = part.mean(axis=0)
                own = Moments(len(part), mean, (part - mean).T @ (part - mean))
                sums[f] = sums[f].merged(own) if f in sums else own
        rows = [(int(f), i, float(m.n), m.mean.tobytes(), m.products[i].tobytes()) for f, m in sums.items() for i in range(width)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["fold", "i", "n", "mean", "products"])

    return run


def _merged(group):
    i, total = group.column("i")[0].as_py(), Moments(0.0, np.zeros(0), np.zeros(0))
    for n, mean, products in zip(*(group.column(c).to_pylist() for c in ("n", "mean", "products"))):
        total = total.merged(Moments(n, np.frombuffer(mean), np.frombuffer(products)[None, :]), slice(i, i + 1))
    return pa.table({"fold": group.column("fold").slice(0, 1), "i": group.column("i").slice(0, 1), "n": [total.n], "mean": [total.mean.tobytes()],
                     "products": [total.products.tobytes()]})


def fold_moments(rows: DataFrame, features: str, labels: str, fold: Column) -> tuple[dict[int, Moments], int]:
    """({fold: moments of [features, labels]}, number of features) from one pass over the rows. Windows
    (arrays of arrays) are flattened; the sums are as many as columns squared, whatever the rows."""
    def vector(c: str) -> Column:
        nested = rows.select(c).dtypes[0][1].startswith("array<array")
        return (F.flatten(c) if nested else F.col(c)).cast("array<double>")

    rows = rows.select(vector(features).alias("x"), vector(labels).alias("y"), fold.cast("bigint").alias("fold"))
    first = rows.select(F.size("x").alias("d"), F.size("y").alias("h")).first()
    if first is None:
        raise ValueError("no rows to fit on")
    cells = rows.mapInArrow(_moments(first["d"] + first["h"]), _MOMENTS).groupBy("fold", "i").applyInArrow(_merged, _MOMENTS)
    parts: dict[int, list] = {}
    for r in cells.orderBy("fold", "i").collect():
        parts.setdefault(r["fold"], []).append(r)
    return {f: Moments(p[0]["n"], np.frombuffer(p[0]["mean"]), np.stack([np.frombuffer(r["products"]) for r in p])) for f, p in parts.items()}, first["d"]


def ridge_of(moments: Moments, d: int, reg: float) -> Ridge:
    """The ridge regression of the columns behind the first ``d`` on those: the penalty is on
    standardised features, ``(ZᵀZ/n + reg·I) w = Zᵀy/n``, and a constant feature has no weight."""
    mean_x, mean_y = moments.mean[:d], moments.mean[d:]
    cov, cross = moments.products[:d, :d] / moments.n, moments.products[:d, d:] / moments.n
    std = np.sqrt(np.maximum(np.diag(cov), 0.0))
    scale = np.divide(1.0, std, out=np.zeros_like(std), where=std > 1e-12 * np.maximum(1.0, np.abs(mean_x)))
    w = np.linalg.solve(cov * np.outer(scale, scale) + reg * np.eye(d), cross * scale[:, None]) * scale[:, None]
    return Ridge(w.T.copy(), mean_y - mean_x @ w)


def fit_ridge(train: DataFrame, features: str = "features", labels: str = "y", reg: float = 1e-3) -> Ridge:
    """Ridge regressions of every element of ``labels`` on ``features``, from one set of normal equations
    whose centred sums one pass gives (see :func:`ridge_of`)."""
    moments, d = fold_moments(train, features, labels, F.lit(0))
    return ridge_of(moments[0], d, reg)


def ridge_r2(model: Ridge, moments: Moments, d: int) -> float:
    """Mean R² of the model's outputs over the rows that the moments describe."""
    w, xx, xy, yy = model.weights, moments.products[:d, :d], moments.products[:d, d:], np.diag(moments.products)[d:]
    offset = moments.mean[d:] - model.bias - w @ moments.mean[:d]
    errors = yy - 2 * np.einsum("hd,dh->h", w, xy) + np.einsum("hd,de,he->h", w, xx, w) + moments.n * offset ** 2
    return float(np.mean(1 - errors / yy))


def cross_validate_ridge(df: DataFrame, keys: list[str], k: int = 5, features: str = "features", labels: str = "y", reg: float = 1e-3) -> DataFrame:
    """(fold, score): R² of ridge regressions on k shuffled folds, each fitted on the rows outside it.

    One pass gives every fold's moments; a fold's model comes from all the others' merged, and its score
    from its own, so no fold is fitted or scored by another pass. Takes window tables as they are.
    """
    moments, d = fold_moments(kfold(df, keys, k), features, labels, F.col("fold"))
    scores = []
    for f, own in sorted(moments.items()):
        rest = [m for g, m in moments.items() if g != f]
        total = Moments(0.0, np.zeros(0), np.zeros(0))
        for m in rest:
            total = total.merged(m)
        scores.append((int(f), ridge_r2(ridge_of(total, d, reg), own, d)))
    return df.sparkSession.createDataFrame(scores, "fold int, score double")


def feature_importance(model: PipelineModel | Boosted, names: list[str]) -> list[tuple[str, float]]:
    """(name, importance) sorted ascending, for tree models."""
    if isinstance(model, Boosted):
        return model.importance(names)
    stage = model.stages[-1]
    if not hasattr(stage, "featureImportances"):
        return []
    imp = stage.featureImportances.toArray()
    return sorted(zip(names, (float(v) for v in imp)), key=lambda t: t[1])


def train_test_scores(train_scored: DataFrame, test_scored: DataFrame, task_type: str, label: str = "label") -> dict:
    from tidepool.operators.evaluate import accuracy, regression_metrics

    if task_type == "classification":
        a = accuracy(train_scored, label, "yhat").first()[0]
        b = accuracy(test_scored, label, "yhat").first()[0]
        return {"train_accuracy": a, "test_accuracy": b}
    a = regression_metrics(train_scored, label, "yhat").first()["r2"]
    b = regression_metrics(test_scored, label, "yhat").first()["r2"]
    return {"train_r2": a, "test_r2": b}


def cross_validate(df: DataFrame, keys: list[str], name: str, params: dict | None, task_type: str, k: int = 5,
                   n_classes: int = 2, label: str = "label", parallelism: int = 2) -> DataFrame:
    """Score (R² or accuracy) of each of k shuffled folds: (fold, score). A fold is a filter on the
    rows' hash, so nothing is shuffled to make one; folds run from a small thread pool."""
    from tidepool.operators.evaluate import accuracy, regression_metrics

    folded = kfold(df, keys, k)

    def run(f: int) -> tuple[int, float]:
        m = fit_model(folded.where(F.col("fold") != f), name, params, task_type, n_classes, label=label)
        scored = predict(m, folded.where(F.col("fold") == f))
        if task_type == "classification":
            return f, float(accuracy(scored, label, "yhat").first()[0])
        return f, float(regression_metrics(scored, label, "yhat").first()["r2"])

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        results = list(pool.map(run, range(k)))
    return df.sparkSession.createDataFrame(results, "fold int, score double")


def cv_report(scores: DataFrame) -> dict:
    """Fold scores, their mean and population standard deviation, rounded to 4, and the number of folds."""
    folds = [r["score"] for r in scores.orderBy("fold").collect()]
    mean = sum(folds) / len(folds)
    std = math.sqrt(sum((s - mean) ** 2 for s in folds) / len(folds))
    return {"cv_scores": [round(s, 4) for s in folds], "mean_score": round(mean, 4), "std_score": round(std, 4), "n_splits": len(folds)}


def save_model(model: PipelineModel | Boosted, path: str) -> None:
    if isinstance(model, Boosted):
        model.save(SparkSession.active(), path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | Boosted | None:
    """The model stored at ``path``; None where nothing is. Any other failure is raised."""
    spark = SparkSession.active()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        return None
    # a pipeline keeps its metadata in a folder of that name
    is_pipeline = files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "metadata"))
    return PipelineModel.load(path) if is_pipeline else Boosted.load(spark, path)
