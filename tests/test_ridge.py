import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import models


def table(spark, x, y):
    return spark.createDataFrame([(i, [float(v) for v in a], [float(v) for v in b]) for i, (a, b) in enumerate(zip(x, y))],
                                 "id bigint, features array<double>, y array<double>").repartition(5)


@pytest.mark.parametrize("offset", [0.0, 1e7, 1e8, 1e9])
def test_large_offsets_cost_no_digits(spark, offset):
    rnd = np.random.default_rng(1)
    x = offset + rnd.normal(size=(300, 1))
    model = models.fit_ridge(table(spark, x, 3 * x + 5), reg=0.0)
    assert model.weights[0, 0] == pytest.approx(3.0, rel=1e-6)


def by_hand(x, y, reg):
    mean, std = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / std
    w = np.linalg.solve(z.T @ z / len(x) + reg * np.eye(x.shape[1]), z.T @ (y - y.mean(axis=0)) / len(x)) / std[:, None]
    return w, y.mean(axis=0) - mean @ w


def test_cross_validation_from_other_folds_moments(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(200, 3)) * [1, 10, 0.1] + [0, 1000, 5]
    y = np.column_stack([x @ [1, 2, 3], x[:, 0]]) + rnd.normal(size=(200, 2))
    df = table(spark, x, y)
    got = {r.fold: r.score for r in models.cross_validate_ridge(df, ["id"], 4, reg=0.2).collect()}
    folds = {r.id: r.fold for r in models.kfold(df, ["id"], 4).select("id", "fold").collect()}
    fold = np.array([folds[i] for i in range(200)])
    assert len(got) == 4
    for f, score in got.items():
        inside = fold == f
        w, b = by_hand(x[~inside], y[~inside], 0.2)
        errors = ((y[inside] - x[inside] @ w - b) ** 2).sum(axis=0)
        assert score == pytest.approx(np.mean(1 - errors / ((y[inside] - y[inside].mean(axis=0)) ** 2).sum(axis=0)))
    assert models.cv_report(models.cross_validate_ridge(df, ["id"], 4, reg=0.2))["n_splits"] == 4


def test_windows_are_flattened(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(80, 4))
    flat = table(spark, x, x[:, :1] * 2)
    nested = flat.withColumn("features", F.array(F.slice("features", 1, 2), F.slice("features", 3, 2)))
    a, b = models.fit_ridge(flat, reg=0.1), models.fit_ridge(nested, reg=0.1)
    assert np.allclose(a.weights, b.weights)
    assert models.cross_validate_ridge(nested, ["id"], 3).count() == 3
