import pytest
from pyspark.sql import functions as F

from tidepool.operators import evaluate, profile


def test_auc_fixtures(spark):
    m5 = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, score double")
    assert evaluate.roc_auc(m5).first()["auc"] == pytest.approx(1.0)
    m6 = spark.createDataFrame([(0, 0.0), (0, 0.0), (1, 1.0), (1, 1.0)], "y int, score double")
    assert evaluate.roc_auc(m6).first()["auc"] == pytest.approx(1.0)
    tie = spark.createDataFrame([(0, 0.5), (1, 0.5)], "y int, score double")
    assert evaluate.roc_auc(tie).first()["auc"] == pytest.approx(0.5)
    curve = evaluate.roc_curve(m5).collect()
    assert (curve[0]["fpr"], curve[0]["tpr"]) == (0.0, 0.0)


def test_regression_metrics_rules(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, yhat double")
    assert evaluate.regression_metrics(df).first()["r2"] == 1.0
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "y double, yhat double")
    assert evaluate.regression_metrics(df).first()["r2"] == 0.0
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0]), ([3.0, 5.0], [2.0, 5.0])], "y array<double>, yhat array<double>")
    m = evaluate.regression_metrics_multi(df).first()
    assert m["mse"] == pytest.approx(0.25) and m["r2"] == pytest.approx((0.5 + 1.0) / 2)


def test_classification_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "y int, yhat int")
    assert evaluate.accuracy(df).first()[0] == pytest.approx(0.75)
    cm = evaluate.confusion_matrix(df)
    assert cm.agg(F.sum("count")).first()[0] == 4
    prf = evaluate.precision_recall_f1(df).first()
    assert prf["precision"] == pytest.approx(2 / 3) and prf["recall"] == pytest.approx(1.0)


def test_profile_fixtures(spark):
    f20 = spark.createDataFrame([(1.0, 10.0, "a"), (2.0, 20.0, "b"), (3.0, 30.0, "a"), (4.0, 40.0, "b"), (5.0, 50.0, "a")],
                                "num1 double, num2 double, cat string")
    c = {(r["col_i"], r["col_j"]): r["r"] for r in profile.correlation_matrix(f20).collect()}
    assert c[("num1", "num2")] == pytest.approx(1.0)
    f21 = spark.createDataFrame([("a",), ("b",), ("c",)], "cat string")
    assert profile.correlation_matrix(f21) is None
    assert profile.histogram(f21).count() == 0
    f22 = spark.createDataFrame([tuple(float(i + j) for j in range(10)) for i in range(20)],
                                ", ".join(f"col_{j} double" for j in range(10)))
    assert profile.histogram(f22).select("column").distinct().count() == 10  # every numeric column
    h = profile.histogram(spark.createDataFrame([(5.0,)] * 3, "v double"), ["v"], bins=2).orderBy("bin").collect()
    assert (h[0]["lo"], h[1]["hi"], h[1]["count"]) == (4.5, 5.5, 3)
    d = {r["column"]: r for r in profile.describe_numeric(f20).collect()}
    assert d["num1"]["p50"] == 3.0 and d["num1"]["std"] == pytest.approx(1.5811388)
    cat = profile.describe_categorical(f20).first()
    assert (cat["top"], cat["freq"], cat["unique"]) == ("a", 3, 2)
    assert profile.profile_shape(f20.limit(0)).first().asDict() == {"n_rows": 0, "n_cols": 0}


def test_null_pairs_one_class_and_empty_tables(spark):
    from tidepool.operators import evaluate, profile

    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 5.0)], "y double, yhat double")
    m = evaluate.regression_metrics(df).first()
    assert (m["mse"], m["mae"]) == (2.5, 1.5) and m["r2"] == 1 - 5 / 2
    assert evaluate.regression_metrics(df.limit(0)).first()["mse"] is None
    one = spark.createDataFrame([(1, 0.2), (1, 0.7)], "y int, score double")
    assert evaluate.roc_auc(one).first()["auc"] is None
    assert all(r["fpr"] is None for r in evaluate.roc_curve(one).where("threshold < 1").collect())
    assert {r["null_pct"] for r in profile.profile_nulls(df.limit(0)).collect()} == {0.0}
    big = spark.createDataFrame([(1, 0.5), (0, 0.4)], "y int, score double")
    assert evaluate.roc_auc(big).first()["auc"] == 1.0


def test_dense_confusion_matrix_and_models_that_do_not_load(spark):
    from tidepool.operators import evaluate

    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "y string, yhat string")
    cells = {(r.truth, r.pred): r["count"] for r in evaluate.confusion_matrix(df).collect()}
    assert len(cells) == 9 and sum(cells.values()) == 3 and cells["c", "c"] == 0
    scored = spark.createDataFrame([(1, 2.0, 3.0)], "row_id int, y double, yhat double")

    def missing():
        return spark.read.parquet("/tmp/no-such-model-here")

    table, failed = evaluate.compare_saved({"good": lambda: scored, "gone": missing})
    assert table.first().asDict() == {"row_id": 1, "truth": 2.0, "good": 3.0} and list(failed) == ["gone"]


def test_quantiles_by_counting_match_numpy(spark, monkeypatch):
    import numpy as np

    from tidepool.operators import stats

    rng = np.random.default_rng(4)
    a = np.r_[rng.normal(size=3000), rng.normal(size=500) * 1e12, np.full(1500, 0.25), [-1e300, 1e300]]
    b = np.r_[rng.integers(0, 5, size=5001).astype(float), [7.0]][:len(a)]
    b = np.r_[b, np.full(len(a) - len(b), 3.0)]
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a double, b double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    monkeypatch.setattr(stats, "LAST_VALUES", 64)
    got = stats.exact_quantiles(df, ["a", "b"], probs)
    assert np.allclose(got["a"], np.quantile(a, probs)) and np.allclose(got["b"], np.quantile(b, probs))
    odd = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.0,), (None,)], "a double")
    assert stats.exact_quantiles(odd, ["a"], [0.0, 0.5, 1.0])["a"] == [float("-inf"), 1.0, float("inf")]
    assert stats.exact_quantiles(df.limit(0), ["a"], [0.5])["a"] == [None]


def test_unparsable_times_give_no_encoding(spark):
    from tidepool.operators import timefeat

    bad = spark.createDataFrame([("2020-01-01", 1), ("soon", 2)], "t string, v int")
    out, names, granularity = timefeat.time_encoding(bad, "t")
    assert (names, granularity) == ([], "auto") and out.columns == ["t", "v"]
    both = spark.createDataFrame([("01/02/2020",), ("13/02/2020",), ("02/13/2020",)], "t string")
    days = lambda first: [str(r[0])[:10] for r in both.select(timefeat.parse_time("t", day_first=first)).collect()]
    assert days(False) == ["2020-01-02", "2020-02-13", "2020-02-13"] and days(True) == ["2020-02-01", "2020-02-13", "2020-02-13"]
