import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators.boosting import Boosted, BoostParams, best_split, fit_boosted


def table(spark, x, y):
    return spark.createDataFrame([(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))], "id bigint, features array<double>, label double").repartition(3)


def scores(model, df):
    return np.array([r.yhat for r in model.predict(df).orderBy("id").select("yhat").collect()])


def brute_boost(x, y, p):
    """Exact greedy boosting of the squared error over all thresholds, level by level."""
    margins = np.full(len(y), y.mean())
    for _ in range(p.n_estimators):
        g, leaves = margins - y, [np.arange(len(y))]
        for _ in range(p.max_depth):
            after = []
            for rows in leaves:
                best = (1e-12, None)
                for f in range(x.shape[1]):
                    for cut in np.unique(x[rows, f])[:-1]:
                        left = x[rows, f] <= cut
                        gl, gr, nl, nr = g[rows[left]].sum(), g[rows[~left]].sum(), left.sum(), (~left).sum()
                        gain = gl ** 2 / (nl + p.reg_lambda) + gr ** 2 / (nr + p.reg_lambda) - (gl + gr) ** 2 / (nl + nr + p.reg_lambda)
                        if min(nl, nr) >= p.min_samples_leaf and nl + nr >= p.min_samples_split and gain > best[0] + 1e-9:
                            best = (gain, (rows[left], rows[~left]))
                after += best[1] or [rows]
            leaves = after
        for rows in leaves:
            margins[rows] -= p.learning_rate * g[rows].sum() / (len(rows) + p.reg_lambda)
    return margins


@pytest.mark.parametrize("p", [BoostParams(n_estimators=3, max_depth=2, learning_rate=0.5), BoostParams(n_estimators=2, max_depth=3, min_samples_leaf=7, reg_lambda=0.0),
                               BoostParams(n_estimators=1, max_depth=3, min_samples_split=40)])
def test_against_exact_greedy_boosting(spark, p):
    rnd = np.random.default_rng(4)
    x = rnd.integers(0, 12, (150, 3)).astype(float)
    y = x[:, 0] * 2 - (x[:, 1] > 5) * 7 + rnd.normal(size=150)
    df = table(spark, x, y)
    assert np.allclose(scores(fit_boosted(df, "regression", p), df), brute_boost(x, y, p))


def test_classes_missing_values_and_round_trip(spark, tmp_path):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(400, 2))
    x[::9, 1] = np.nan
    y = (x[:, 0] > 0.3) + (x[:, 0] > 1)
    df = table(spark, x, y)
    model = fit_boosted(df, "classification", BoostParams(n_estimators=12, max_depth=None, max_leaves=4, learning_rate=0.3), n_classes=3)
    assert (scores(model, df) == y).mean() > 0.98
    assert all(len([f for f in t.feature if f < 0]) <= 4 for trees in model.rounds for t in trees) and len(model.rounds[0]) == 3
    assert model.importance(["a", "b"])[-1][0] == "a"
    model.save(spark, str(tmp_path / "m"))
    assert (scores(Boosted.load(spark, str(tmp_path / "m")), df) == scores(model, df)).all()
    two = fit_boosted(table(spark, x, y > 0), "classification", BoostParams(n_estimators=5))
    p = np.array([r[0] for r in two.predict(df).orderBy("id").select("probability").collect()])
    assert p.shape == (400, 2) and np.allclose(p.sum(axis=1), 1) and ((p[:, 1] > 0.5) == (y > 0)).mean() > 0.98


def test_more_rounds_lower_the_error_across_stored_margins(spark):
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(600, 2))
    y = np.sin(2 * x[:, 0]) + x[:, 1] ** 2
    df = table(spark, x, y)
    model = fit_boosted(df, "regression", BoostParams(n_estimators=13, max_depth=3, learning_rate=0.3))
    errors = [((Boosted("regression", 1, model.base, model.rounds[:k]).margins(x)[:, 0] - y) ** 2).mean() for k in range(14)]
    assert all(b < a for a, b in zip(errors, errors[1:])) and errors[-1] < 0.1 * errors[0]


def test_nothing_to_split_and_no_rows(spark):
    df = table(spark, [[1.0], [1.0]], [3.0, 5.0])
    assert scores(fit_boosted(df, "regression"), df) == pytest.approx([4.0, 4.0])
    with pytest.raises(ValueError):
        fit_boosted(df.limit(0), "regression")
    with pytest.raises(ValueError):
        BoostParams(max_depth=None)


def test_best_split_prefers_the_first_of_equal_gains():
    sums = np.zeros((2, 256, 3))
    sums[:, 0], sums[:, 5] = (4.0, 2.0, 2.0), (-4.0, 2.0, 2.0)
    gain, f, b, left, whole = best_split(sums, BoostParams(reg_lambda=0.0))
    assert (gain, f, b) == (16.0, 0, 0) and left.tolist() == [4, 2, 2] and whole.tolist() == [0, 4, 4]
    assert best_split(sums, BoostParams(min_samples_leaf=3))[0] == 0


def test_registry_names_honour_their_parameters(spark):
    from tidepool.operators import models

    assert models.boost_params("xgboost_regressor", {"max_depth": "None"}).max_depth == 6
    p = models.boost_params("lightgbm_classifier", {"min_samples_leaf": "50", "learning_rate": 0.5})
    assert (p.max_depth, p.max_leaves, p.min_samples_leaf, p.learning_rate, p.reg_lambda) == (None, 31, 50, 0.5, 0.0)
    with pytest.raises(ValueError):
        models.fit_model(spark.range(1), "xgboost_regressor", task_type="classification")
    rnd = np.random.default_rng(7)
    x = rnd.normal(size=(120, 1))
    df = table(spark, x, x[:, 0])
    for name in ("xgboost_regressor", "gbt_regressor"):
        model = models.fit_model(df, name, {"n_estimators": 1, "max_depth": 3, "min_samples_leaf": 50}, "regression")
        assert models.predict(model, df).select("yhat").distinct().count() <= 2
    assert models.feature_importance(model, ["x"]) == [("x", 1.0)]


def test_saved_boosters_are_told_from_pipelines(spark, tmp_path):
    from tidepool.operators import models

    df = table(spark, [[1.0], [2.0], [3.0], [4.0]], [1.0, 1.0, 5.0, 5.0])
    for name in ("lightgbm_regressor", "decision_tree_regressor"):
        model, path = models.fit_model(df, name, {"max_depth": 2}, "regression"), str(tmp_path / name)
        models.save_model(model, path)
        assert np.allclose(scores(models.load_model(path), df) if name.startswith("light") else
                           [r.yhat for r in models.predict(models.load_model(path), df).orderBy("id").collect()],
                           [r.yhat for r in models.predict(model, df).orderBy("id").collect()])
    assert models.load_model(str(tmp_path / "none")) is None


def test_many_rows_are_dealt_to_all_tasks_and_older_margins_dropped(spark, monkeypatch):
    """Rows of one split are dealt anew; a round's margins are stored, the round before is dropped."""
    from pathlib import Path

    from tidepool import session
    from tidepool.operators import boosting

    monkeypatch.setattr(session, "ROWS_PER_TASK", 100, raising=False)
    folders = []
    monkeypatch.setattr(boosting, "scratch_folder", lambda s: folders.append(session.scratch_folder(s)) or folders[-1])
    rnd = np.random.default_rng(8)
    x = rnd.integers(0, 12, (500, 3)).astype(float)
    y = x[:, 0] * 2 - (x[:, 1] > 5) * 7 + rnd.normal(size=500)
    df, p = table(spark, x, y).coalesce(1), BoostParams(n_estimators=3, max_depth=2, learning_rate=0.5)
    assert np.allclose(scores(fit_boosted(df, "regression", p), df), brute_boost(x, y, p))
    kept = list(Path(folders[0].removeprefix("file:")).iterdir())
    assert [f.name for f in kept if f.is_dir()] == ["rows-2"] and len(list(Path(folders[0].removeprefix("file:"), "rows-2").glob("part-*"))) > 1


def test_many_rows_of_equal_bins_and_class_are_counted_once(spark, monkeypatch):
    """The trees are those of all rows; batches of packed rows are small."""
    from tidepool import session
    from tidepool.operators import boosting

    rnd = np.random.default_rng(9)
    x = rnd.integers(0, 5, (900, 2)).astype(float)
    x[::50, 1] = np.nan
    y = (x[:, 0] + rnd.normal(size=900) > 2).astype(int) + (x[:, 0] > 3)
    df, p = table(spark, x, y).coalesce(1), BoostParams(n_estimators=3, max_depth=3, learning_rate=0.5, min_samples_leaf=15)
    few = fit_boosted(df, "classification", p, n_classes=3)
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    seen, grow = [], boosting._grow
    monkeypatch.setattr(boosting, "_grow", lambda data, *a: seen.append(data) or grow(data, *a))
    many = fit_boosted(df, "classification", p, n_classes=3)
    rows = seen[-1].collect()
    assert sum(len(r["y"]) // 8 for r in rows) == len({(*np.nan_to_num(a), b) for a, b in zip(x, y)}) < 100
    assert sum(np.frombuffer(r["weight"]).sum() for r in rows) == 900
    assert seen[-1].sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(session.PACKED_BATCH_BYTES)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != str(session.PACKED_BATCH_BYTES)
    for a, b in zip(few.rounds, many.rounds):
        for s, t in zip(a, b):
            assert (s.feature, s.threshold, s.left) == (t.feature, t.threshold, t.left) and np.allclose(s.value, t.value)


def test_counted_rows_grow_the_trees_of_most_leaves_alike(spark, monkeypatch):
    """As ``lightgbm_*`` grow: the splits of largest gain first, no bound on the depth."""
    from tidepool import session
    from tidepool.operators import boosting, models

    rnd = np.random.default_rng(10)
    x = rnd.integers(0, 6, (800, 3)).astype(float)
    y = (x[:, 0] + rnd.normal(size=800) > 3).astype(int) + (x[:, 1] > 3)
    df, params = table(spark, x, y).coalesce(1), {"n_estimators": 2, "min_samples_leaf": 5}
    few = models.fit_model(df, "lightgbm_classifier", params, "classification", n_classes=3)
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    seen, grow = [], boosting._grow
    monkeypatch.setattr(boosting, "_grow", lambda data, *a: seen.append(sum(len(r["y"]) // 8 for r in data.collect())) or grow(data, *a))
    many = models.fit_model(df, "lightgbm_classifier", params, "classification", n_classes=3)
    assert seen == [len({(*a, b) for a, b in zip(x, y)})] * 2
    for a, b in zip(few.rounds, many.rounds):
        for s, t in zip(a, b):
            assert (s.feature, s.threshold, s.left) == (t.feature, t.threshold, t.left) and np.allclose(s.value, t.value)
