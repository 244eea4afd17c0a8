import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import scale, split
from tidepool.plans.order import with_row_index


def _col(spark, vals, name="y"):
    return spark.createDataFrame([(float(v),) for v in vals], f"{name} double")


def test_mean_and_minmax_scaling(spark):
    tr, te = _col(spark, [1, 2, 3, 4, 5]), _col(spark, [2.5, 4.5])
    p = scale.fit_scaler(tr, ["y"], "mean")
    v = np.array([r["y"] for r in scale.apply_scaler(tr, p).collect()])
    assert v.mean() == pytest.approx(0) and v.std() == pytest.approx(1)
    p = scale.fit_scaler(_col(spark, [10, 20, 30, 40]), ["y"], "minmax")
    t = [r["y"] for r in scale.apply_scaler(_col(spark, [15, 35, -5, 50]), p).collect()]
    assert t[:2] == pytest.approx([1 / 6, 5 / 6]) and t[2] < 0 and t[3] > 1


def test_constant_column_and_roundtrip(spark):
    c = _col(spark, [5, 5, 5])
    for m in ("mean", "minmax"):
        p = scale.fit_scaler(c, ["y"], m)
        assert {r["y"] for r in scale.apply_scaler(c, p).collect()} == {0.0}
    vals = list(np.linspace(100, 500, 20))
    d = _col(spark, vals)
    for m in ("mean", "minmax"):
        p = scale.fit_scaler(d, ["y"], m)
        back = [r["y"] for r in scale.unscale_target(scale.apply_scaler(d, p), p, ["y"]).collect()]
        assert back == pytest.approx(vals, rel=1e-9)


def test_windowed_statistics_equal_flattened_windows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=40)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double")
    idx, n = with_row_index(df, ["i"])
    L, P = 5, 2
    flat = np.concatenate([x[i:i + L] for i in range(n - L - P + 1)])
    p = scale.fit_scaler_windowed(idx, ["v"], n, L, P, "mean")
    assert p.mean[0] == pytest.approx(flat.mean()) and p.std[0] == pytest.approx(flat.std())
    ys = np.concatenate([x[i + L:i + L + P] for i in range(n - L - P + 1)])
    p = scale.fit_scaler_windowed(idx, ["v"], n, L, P, "mean", part="y")
    assert p.mean[0] == pytest.approx(ys.mean()) and p.std[0] == pytest.approx(ys.std())


def test_target_policy():
    assert scale.target_policy("small", None, "regression") == "mean"
    assert scale.target_policy("large", None, "regression") is None
    assert scale.target_policy("large", "minmax", "regression") == "minmax"
    assert scale.target_policy("small", "minmax", "classification") is None


def test_random_split_sizes(spark):
    f10 = spark.createDataFrame([(float(i), float(i * 10), float(i * 100)) for i in range(1, 6)], "a double, b double, t double")
    tr, te = split.random_split(f10, ["a"], 0.4)
    assert (tr.count(), te.count()) == (3, 2)
    f13 = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0)], "x double, y double")
    tr, te = split.random_split(f13, ["x"], 0.5)
    assert (tr.count(), te.count()) == (1, 1)
    assert tr.intersect(te).count() == 0


def test_chronological_and_borders(spark):
    df = spark.range(50).withColumnRenamed("id", "t")
    idx, n = with_row_index(df, ["t"])
    tr, te, cut = split.chronological_split(idx, n, 0.2)
    assert cut == 40 and tr.count() == 40 and te.count() == 10
    with pytest.raises(ValueError):
        split.chronological_split(idx, 5, 0.2, min_train=11)
    r = split.border_ranges(100, 10)
    assert r == {"train": (0, 70), "val": (60, 80), "test": (70, 100)}


def test_kfold_sizes(spark):
    df = spark.range(23)
    f = split.kfold(df, ["id"], 5)
    sizes = [r["count"] for r in f.groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [5, 5, 5, 4, 4]
    tr, val, te = split.fold_holdout(f, 0, ["id"])
    assert te.count() == 5 and val.count() == 4 and tr.count() == 14


def test_limit_series(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("s"), "id")
    assert split.limit_series(df, "s", 3).select("s").distinct().count() == 3
    assert split.limit_series(df, "s", 0.5).select("s").distinct().count() == 5


def test_random_cuts_with_repeated_keys_need_no_shuffle(spark):
    from pyspark.sql import functions as F

    from tidepool.operators import split

    hot = spark.range(900).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    folds = split.kfold(hot, ["k"], 7, 1)
    sizes = sorted(r["count"] for r in folds.groupBy("fold").count().collect())
    assert sizes == [128, 128, 128, 129, 129, 129, 129] and folds.select("v").distinct().count() == 900
    train, test = split.random_split(hot, ["k"], 0.25, 3)
    assert (train.count(), test.count()) == (675, 225)
    unique = split.random_split_labels(spark.range(1000), ["id"], 0.2)
    assert "Exchange" not in unique._jdf.queryExecution().executedPlan().toString()
    assert unique.where("side = 'test'").count() == 200


def test_series_limit_ignores_null_ids_and_agrees_on_any_limit(spark):
    from tidepool.operators import split

    df = spark.createDataFrame([(None, 1), ("b", 2), ("a", 3), ("a", 4), ("c", 5)], "s string, v int")
    values = lambda limit: sorted(r.v for r in split.limit_series(df, "s", limit).collect())
    assert values(2) == [2, 3, 4] and values(3) == values(5_000_000) == [2, 3, 4, 5] and values(0.4) == [3, 4]


def test_constant_series_and_empty_columns(spark):
    from tidepool.operators import scale

    df = spark.createDataFrame([("a", 1.0, None), ("a", 1.0, None), ("b", 1.0, None), ("b", 3.0, None)], "s string, v double, n double")
    out, _ = scale.series_normalize(df, ["v"], "per_sample_std", ["s"])
    assert sorted(str(r.v) for r in out.collect() if r.s == "a") == ["None", "None"]
    for method in ("minmax", "mean"):
        assert scale.apply_scaler(df, scale.fit_scaler(df, ["v", "n"], method)).where("n is not null").count() == 0
