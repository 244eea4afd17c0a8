import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import epochs, evaluate
from tidepool.operators.split import random_split
from tidepool.sources import io


def table(spark, x, y):
    return spark.createDataFrame([(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))], "id bigint, features array<double>, label double").repartition(3)


def test_gradients_match_differences():
    rnd = np.random.default_rng(0)
    for task, outputs in (("regression", 1), ("classification", 3)):
        weights = [rnd.normal(size=s) for s in ((4, 5), (5,), (5, outputs), (outputs,))]
        x, y = rnd.normal(size=(20, 4)), rnd.integers(0, 3, 20).astype(float)
        _, gradient, _ = epochs.loss_and_gradient(task, weights, x, y)
        for w, g in zip(weights, gradient):
            at = tuple(rnd.integers(0, s) for s in w.shape)
            w[at] += 1e-6
            up = epochs.loss_and_gradient(task, weights, x, y)[0]
            w[at] -= 2e-6
            down = epochs.loss_and_gradient(task, weights, x, y)[0]
            w[at] += 1e-6
            assert g[at] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-5)


def test_a_convex_loss_reaches_its_closed_form(spark, tmp_path):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(200, 2)) * [1, 5] + [3, -2]
    df = table(spark, x, x @ [2.0, -1.0] + 4 + rnd.normal(size=200) * 0.1)
    net = epochs.fit_epochs(df, ["id"], "regression", hidden=(), epochs=60, rate=0.4, patience=60)
    train, _ = random_split(df, ["id"], 0.2, 42)
    rows = train.collect()
    a = np.column_stack([np.array([r.features for r in rows]), np.ones(len(rows))])
    exact = np.linalg.lstsq(a, np.array([r.label for r in rows]), rcond=None)[0]
    got = (net.weights[0][:, 0] * net.scale).tolist()
    assert got == pytest.approx(exact[:2].tolist(), abs=0.02)
    history = net.history_rows(df)
    assert history.count() == 60 and net.history[-1][1] < net.history[0][1]
    final = evaluate.training_history(history).first()
    assert final["epochs"] == 60 and final["final_val_loss"] == round(net.history[-1][2], 6) and final["final_val_metric"] > 0.99
    io.write_history(history, str(tmp_path / "h"))
    assert spark.read.option("header", True).csv(str(tmp_path / "h")).count() == 60


def test_early_stopping_restores_the_best_weights(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(60, 4))
    df = table(spark, x, rnd.normal(size=60))  # nothing to learn: the holdout soon gets worse
    net = epochs.fit_epochs(df, ["id"], "regression", hidden=(16,), epochs=25, rate=0.1, patience=3)
    losses = [h[2] for h in net.history]
    assert len(losses) < 25 and net.best_epoch == int(np.argmin(losses)) + 1 and len(losses) == net.best_epoch + 3
    _, held = random_split(df, ["id"], 0.2, 42)
    errors = [(r.yhat - r.label) ** 2 / 2 for r in net.predict(held).collect()]
    assert np.mean(errors) == pytest.approx(min(losses))


def test_classes_windows_and_cross_validation(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(150, 4))
    df = table(spark, x, (x[:, 0] + x[:, 3] > 0) * 1.0)
    nested = df.withColumn("features", F.array(F.slice("features", 1, 2), F.slice("features", 3, 2)))
    scores = [r.score for r in epochs.cross_validate_epochs(nested, ["id"], "classification", 2, hidden=(4,), epochs=12, steps=2, rate=0.1).collect()]
    assert len(scores) == 2 and min(scores) > 0.8
    with pytest.raises(ValueError):
        epochs.fit_epochs(df.limit(0), ["id"], "regression")
