"""Learners on many rows that lie in one split."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool import session
from tidepool.operators import forest, models, perceptron


def one_split(spark, n=600, seed=3):
    rnd = np.random.default_rng(seed)
    x = rnd.integers(0, 9, (n, 3)).astype(float)
    rows = [(i, [float(v) for v in r], int(r[0] > 3) + int(r[1] > 5)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, features array<double>, label int").coalesce(1)


@pytest.mark.parametrize("name, params", [("mlp_classifier", {"hidden_layers": "4", "epochs": 40}), ("random_forest_classifier", {"n_estimators": 4}),
                                          ("random_forest_regressor", {"n_estimators": 4})])
def test_many_rows_of_one_split_are_dealt_to_all_cores(spark, monkeypatch, name, params):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    seen, fit = [], models.Pipeline.fit
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, data: seen.append((data.rdd.getNumPartitions(), data.count())) or fit(self, data))
    df, cores = one_split(spark), spark.sparkContext.defaultParallelism
    model = models.fit_model(df, name, params, models.REGISTRY[name].task, n_classes=3)
    tasks, rows = seen[0]
    assert rows == 600 and tasks >= 6 and tasks % cores == 0
    test = models.dealt(df)
    assert test.rdd.getNumPartitions() == tasks and df.exceptAll(test).isEmpty() and test.exceptAll(df).isEmpty()
    right = models.predict(model, test).where(F.abs(F.col("yhat") - F.col("label")) < 0.5).count()
    assert right > 500


def test_few_rows_stay_where_they_are(spark):
    df = one_split(spark)
    assert models.dealt(df) is df


def test_forests_keep_the_node_of_each_row(spark):
    """Kept nodes change no prediction: a pass does not walk every tree from its root again."""
    df = one_split(spark)
    for name in ("random_forest_classifier", "random_forest_regressor"):
        est = models.build_estimator(name, {"n_estimators": 6, "max_depth": 5}, models.REGISTRY[name].task, n_classes=3)
        assert est.getCacheNodeIds()
        data = models.with_vector(df).withColumn("label", F.col("label").cast("double"))
        kept, walked = (est.copy({est.cacheNodeIds: k}).fit(data).transform(data).orderBy("id") for k in (True, False))
        assert [r.prediction for r in kept.collect()] == [r.prediction for r in walked.collect()]


def test_epochs_pack_rows_deal_many_and_take_no_gradient_of_the_holdout(spark, monkeypatch):
    from pathlib import Path

    from tidepool.operators import epochs

    folders, passes, summed = [], [], epochs._summed
    monkeypatch.setattr(epochs, "scratch_folder", lambda s: folders.append(session.scratch_folder(s)) or folders[-1])
    monkeypatch.setattr(epochs, "_summed", lambda rows, net, learning=True: passes.append((rows.rdd.getNumPartitions(), learning)) or summed(rows, net, learning))
    df, found = one_split(spark), []
    for limit in (10_000, 100):
        monkeypatch.setattr(session, "ROWS_PER_TASK", limit)
        net = epochs.fit_epochs(df, ["id"], "regression", hidden=(8,), epochs=6, steps=2, rate=0.1)
        found.append([r.yhat for r in net.predict(df).orderBy("id").collect()])
        folder = Path(folders[-1].removeprefix("file:"))
        assert sorted(p.name for p in folder.iterdir() if p.is_dir()) == ["held", "train"]
        assert [learning for _, learning in passes] == [True, True, False] * len(net.history)
        assert (min(n for n, _ in passes) > 1) == (limit == 100)
        passes.clear()
    assert np.allclose(found[0], found[1])


def test_gbt_classifier_fits_one_weighted_row_for_each_combination_of_bins(spark, monkeypatch, tmp_path):
    df = one_split(spark, 900, 5)
    twice = df.unionByName(df.withColumn("id", F.col("id") + 900)).coalesce(1)
    params = {"n_estimators": 4, "max_depth": 3, "min_samples_leaf": 20}
    plain = models.fit_model(twice, "gbt_classifier", params, "classification", n_classes=3)
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    seen, fit = [], models.Pipeline.fit
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, data: seen.append(data.agg(F.count("*"), F.sum("weight")).first()) or fit(self, data))
    model = models.fit_model(twice, "gbt_classifier", params, "classification", n_classes=3)
    assert seen[0][0] == df.select("features", "label").distinct().count() and seen[0][1] == 1800
    models.save_model(model, str(tmp_path / "gbt"))
    a, b, c = (models.predict(m, twice).orderBy("id") for m in (plain, model, models.load_model(str(tmp_path / "gbt"))))
    assert a.columns == b.columns == c.columns
    assert [r.yhat for r in a.collect()] == [r.yhat for r in b.collect()] == [r.yhat for r in c.collect()]


@pytest.mark.parametrize("hidden, epochs", [("4", 25), ("5,4", 12)])
def test_perceptron_on_many_rows_is_mllibs(spark, monkeypatch, tmp_path, hidden, epochs):
    """Blocks of MLlib (128 rows) are all full here, so its means over blocks are means over rows."""
    df, params = one_split(spark, 1280, 7), {"hidden_layers": hidden, "epochs": epochs}
    few = models.fit_model(df, "mlp_classifier", params, "classification", n_classes=3)
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    passes, whole = [], perceptron.mean_loss
    monkeypatch.setattr(perceptron, "mean_loss", lambda rows, flat, sizes: passes.append(whole(rows, flat, sizes)) or passes[-1])
    many = models.fit_model(df, "mlp_classifier", params, "classification", n_classes=3)
    assert len(passes) > epochs and passes[-1][0] < 0.6 * passes[0][0]
    assert np.allclose(few.stages[-1].weights.toArray(), many.stages[-1].weights.toArray(), rtol=1e-4, atol=1e-4)
    models.save_model(many, str(tmp_path / "mlp"))
    a, b, c = (models.predict(m, df).orderBy("id") for m in (few, many, models.load_model(str(tmp_path / "mlp"))))
    assert a.columns == b.columns == c.columns and many.stages[-1].getMaxIter() == epochs
    a, b, c = (m.collect() for m in (a, b, c))
    assert [r.yhat for r in a] == [r.yhat for r in b] == [r.yhat for r in c]
    assert np.allclose([r.probability for r in a], [r.probability for r in b], atol=1e-4)


def test_perceptron_sums_are_the_derivative_of_the_loss():
    rnd, sizes = np.random.default_rng(1), [3, 5, 4, 3]
    x, y, flat = rnd.normal(size=(3, 50)), rnd.integers(0, 3, 50), rnd.normal(size=3 * 5 + 5 + 5 * 4 + 4 + 4 * 3 + 3)
    room = [(np.empty((h, 64)), np.empty((h, 64))) for h in sizes[1:-1]]
    loss = lambda w: perceptron.loss_and_gradient(w, sizes, x, y, room)[0]
    steps = np.eye(len(flat)) * 1e-6
    assert np.allclose([(loss(flat + s) - loss(flat - s)) / 2e-6 for s in steps], perceptron.loss_and_gradient(flat, sizes, x, y, room)[1], atol=1e-5)


@pytest.mark.parametrize("features, label", [([1.0, float("nan"), 0.0], 0), ([1.0, 2.0, 0.0], 3), ([1.0, 2.0, 0.0], None)])
def test_perceptron_refuses_rows_that_mllib_refuses(spark, monkeypatch, features, label):
    df = one_split(spark).union(spark.createDataFrame([(-1, features, label)], "id long, features array<double>, label int"))
    for limit in (10_000, 100):
        monkeypatch.setattr(session, "ROWS_PER_TASK", limit)
        with pytest.raises(Exception):
            models.fit_model(df, "mlp_classifier", {"hidden_layers": "4", "epochs": 2}, "classification", n_classes=3)


@pytest.mark.parametrize("name", ["random_forest_classifier", "random_forest_regressor"])
def test_forests_on_many_rows_hand_mllib_no_row(spark, monkeypatch, tmp_path, name):
    """MLlib stores a number for each row and tree, twice; here it only writes the model of a row for each class."""
    df, task = one_split(spark, 1500, 11), models.REGISTRY[name].task
    params = {"n_estimators": 30, "min_samples_leaf": 20}
    few = models.fit_model(df, name, params, task, n_classes=3)
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    kind, seen = type(models.build_estimator(name, params, task, n_classes=3)), []
    fit = kind._fit
    monkeypatch.setattr(kind, "_fit", lambda self, data: seen.append(data.count()) or fit(self, data))
    many, again = (models.fit_model(df, name, params, task, n_classes=3) for _ in range(2))
    assert max(seen) <= 3 and type(many.stages[-1]) is type(few.stages[-1])
    x, y = ({p.name: v for p, v in m.stages[-1].extractParamMap().items()} for m in (few, many))
    assert x == y and x["numTrees"] == many.stages[-1].getNumTrees == 30
    models.save_model(many, str(tmp_path / "forest"))
    a, b, c, d = (models.predict(m, df).orderBy("id") for m in (few, many, models.load_model(str(tmp_path / "forest")), again))
    assert a.schema == b.schema == c.schema
    a, b, c, d = (np.array([[r.yhat, *(r.probability if "probability" in r else [])] for r in m.collect()]) for m in (a, b, c, d))
    assert (b == c).all() and (b == d).all()
    assert np.abs(a[:, 1:] - b[:, 1:]).mean() < 0.04 if a.shape[1] > 1 else np.abs(a - b).mean() < 0.06
    x, y = (np.array([v for _, v in models.feature_importance(m, ["a", "b", "c"])]) for m in (few, many))
    assert np.allclose(x, y, atol=0.2)


@pytest.mark.parametrize("classes", [True, False])
def test_trees_grown_from_sums_are_mllibs(spark, classes):
    """All features tried and every row held once: the tree that MLlib grows, pruned alike."""
    df = one_split(spark, 700, 13)
    rows = df.orderBy("id").collect()
    x, y = np.array([r.features for r in rows]).astype(int), np.array([r.label for r in rows])
    name, sizes, cuts = "decision_tree_classifier" if classes else "decision_tree_regressor", [9] * 3, [[float(v) for v in range(8)]] * 3
    sums = np.eye(3)[y] if classes else np.column_stack([np.ones(len(y)), y, y * y]).astype(float)
    cells, where = np.unique(x, axis=0, return_inverse=True)
    merged = np.zeros((len(cells), 3))
    np.add.at(merged, where.ravel(), sums)
    for depth, leaf in ((4, 1), (10, 12), (0, 1)):
        own = forest.nodes_of(forest.grow(cells.astype(np.uint8), merged, sizes, classes, 3, depth, leaf, np.random.default_rng(1)), cuts, classes)
        model = models.fit_model(df, name, {"max_depth": depth, "min_samples_leaf": leaf}, models.REGISTRY[name].task, n_classes=3)
        path = f"{session.scratch_folder(spark)}/tree"
        model.stages[-1].write().save(path)
        theirs = [r.asDict(True) for r in spark.read.parquet(f"{path}/data").orderBy("id").collect()]
        theirs = [r.get("nodeData", r) for r in theirs]
        assert len(own) == len(theirs)
        for a, b in zip(own, theirs):
            for c in ("id", "prediction", "impurity", "impurityStats", "gain", "leftChild", "rightChild"):
                assert np.allclose(a[c], b[c][:3] if c == "impurityStats" else b[c]), (c, a, b)
            assert a["split"]["featureIndex"] == b["split"]["featureIndex"]
            assert np.allclose(np.floor(b["split"]["leftCategoriesOrThreshold"]), a["split"]["leftCategoriesOrThreshold"])


def test_trees_hold_rows_as_poisson_draws_say():
    n = np.r_[np.ones(4000, dtype=np.int64), np.full(4000, 7)]
    held = forest.held_rows(np.random.default_rng(2), n, 50)
    for part, mean in ((held[:4000], 1.0), (held[4000:], 7.0)):
        assert abs(part.mean() - mean) < 0.03 and abs(part.var() / mean - 1) < 0.02
    assert np.allclose(np.bincount(held[:4000].astype(int).ravel(), minlength=4)[:4] / 200_000, forest._CHANCES[:4], atol=0.005)
    rare = forest.held_rows(np.random.default_rng(3), np.ones(200_000, dtype=np.int64), 50)
    assert abs((rare >= 8).mean() / 1.02e-5 - 1) < 0.4


def test_a_combination_of_many_rows_is_drawn_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    sizes, drawn = [], forest._drawn
    path = f"{session.scratch_folder(spark)}/sizes"

    def counted(*args):
        run = drawn(*args)

        def count(batches):
            import os
            import uuid

            held = list(batches)
            os.makedirs(path.removeprefix("file:"), exist_ok=True)
            with open(f"{path.removeprefix('file:')}/{uuid.uuid4().hex}", "w") as out:
                out.write(str(sum(b.num_rows for b in held)))
            yield from run(iter(held))

        return count

    monkeypatch.setattr(forest, "_drawn", counted)
    rows = [(i, [float(i % 5 if i % 2 else 0), 1.0], float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label double").coalesce(1)
    model = models.fit_model(df, "random_forest_regressor", {"n_estimators": 3}, "regression")
    from pathlib import Path

    sizes = [int(p.read_text()) for p in Path(path.removeprefix("file:")).iterdir()]
    assert sum(sizes) == 2000 and max(sizes) < 600
    assert models.predict(model, df).where("yhat between 800 and 1200").count() == 2000


def test_gbt_regressor_fits_one_weighted_row_for_each_combination_of_bins(spark, monkeypatch, tmp_path):
    """A row's label is a number of its own: the mean of a combination's labels grows the trees of all its rows."""
    df = one_split(spark, 900, 17).withColumn("label", F.col("label") * 10 + F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000 + 1000)
    params = {"n_estimators": 4, "max_depth": 3, "min_samples_leaf": 20}
    plain = models.fit_model(df, "gbt_regressor", params, "regression")
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    seen, fit = [], models.Pipeline.fit
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, data: seen.append(data.agg(F.count("*"), F.sum("weight")).first()) or fit(self, data))
    model = models.fit_model(df, "gbt_regressor", params, "regression")
    assert seen[0][0] == df.select("features").distinct().count() < 600 and seen[0][1] == 900
    models.save_model(model, str(tmp_path / "gbt"))
    a, b, c = (models.predict(m, df).orderBy("id") for m in (plain, model, models.load_model(str(tmp_path / "gbt"))))
    assert a.columns == b.columns == c.columns
    a, b, c = ([r.yhat for r in m.collect()] for m in (a, b, c))
    assert np.allclose(a, b, rtol=1e-9) and b == c


@pytest.mark.parametrize("features, label", [([1.0, float("nan"), 0.0], 0.0), ([1.0, 2.0, float("inf")], 0.0), ([1.0, 2.0, 0.0], None)])
def test_gbt_regressor_refuses_rows_that_mllib_refuses(spark, monkeypatch, features, label):
    rows = one_split(spark).withColumn("label", F.col("label").cast("double"))
    df = rows.union(spark.createDataFrame([(-1, features, label)], "id long, features array<double>, label double"))
    for limit in (10_000, 100):
        monkeypatch.setattr(session, "ROWS_PER_TASK", limit)
        with pytest.raises(Exception):
            models.fit_model(df, "gbt_regressor", {"n_estimators": 1, "max_depth": 1}, "regression")


def test_perceptron_counts_equal_rows_once(spark, monkeypatch):
    """Weights stand for copies: loss and gradient are those of all rows."""
    df = one_split(spark, 500, 19)
    df = df.union(df.where("id % 3 = 0")).union(df.where("id % 5 = 0")).coalesce(1)
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    passes, whole = [], perceptron.mean_loss
    monkeypatch.setattr(perceptron, "mean_loss", lambda rows, flat, sizes: passes.append((rows.collect(), flat, *whole(rows, flat, sizes))) or passes[-1][2:])
    models.fit_model(df, "mlp_classifier", {"hidden_layers": "4", "epochs": 2}, "classification", n_classes=3)
    rows, flat, loss, gradient = passes[-1]
    assert sum(len(r["y"]) // 8 for r in rows) == df.select("features", "label").distinct().count() < df.count()
    every, sizes = df.collect(), [3, 4, 3]
    x, y = np.array([r.features for r in every]).T, np.array([r.label for r in every])
    own = perceptron.loss_and_gradient(flat, sizes, x, y, [(np.empty((4, len(y))), np.empty((4, len(y))))])
    assert np.isclose(own[0] / len(y), loss) and np.allclose(own[1] / len(y), gradient)
