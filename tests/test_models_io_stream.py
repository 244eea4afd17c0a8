import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import models
from tidepool.operators.features import assemble_features, fit_label_encoder, infer_task, label_decode, label_encode
from tidepool.sources import io
from tidepool.streaming.apply import prepare_rows, stream_to_table

from .conftest import SF_SMALL


def _regression(spark, n=200, seed=42):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = x @ np.array([1.0, -2.0, 0.5, 0.0]) + rng.normal(scale=0.1, size=n)
    return spark.createDataFrame([(i, [float(v) for v in x[i]], float(y[i])) for i in range(n)],
                                 "row_id long, features array<double>, label double")


def test_regression_models_fit_and_predict(spark):
    df = _regression(spark)
    for name in ("random_forest_regressor", "decision_tree_regressor", "xgboost_regressor", "linear_forecast"):
        asked = {"n_estimators": "10", "max_depth": "None"}
        m = models.fit_model(df, name, {k: v for k, v in asked.items() if k in models.PARAMS[name]}, "regression")
        pred = models.predict(m, df)
        assert pred.where(F.isnan("yhat") | F.col("yhat").isNull()).count() == 0
    imp = models.feature_importance(models.fit_model(df, "random_forest_regressor", {"n_estimators": 5}),
                                    ["a", "b", "c", "d"])
    assert [n for n, _ in imp][-1] == "b"


def test_classifiers_and_task_checks(spark):
    df = _regression(spark).withColumn("label", (F.col("label") > 0).cast("double"))
    m = models.fit_model(df, "random_forest_classifier", {"n_estimators": 5}, "classification")
    p = models.predict(m, df)
    sums = p.select(F.aggregate("probability", F.lit(0.0), lambda a, v: a + v).alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in sums)
    with pytest.raises(ValueError):
        models.fit_model(df, "random_forest_regressor", {}, "classification")
    with pytest.raises(ValueError):
        models.get_spec("nope")
    multi = _regression(spark).withColumn("label", F.floor(F.abs(F.col("label"))) % 3)
    m = models.fit_model(multi, "xgboost_classifier", {"n_estimators": 3}, "classification", n_classes=3)
    assert models.predict(m, multi).select("yhat").distinct().count() >= 2


def test_string_labels_round_trip(spark):
    rows = [(float(i), float(i % 3), "cat" if i % 2 else "dog") for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, target string")
    assert infer_task(df, "target") == ("classification", 2)
    d = fit_label_encoder(df, "target")
    assert [r["label"] for r in d.table.orderBy("code").collect()] == ["cat", "dog"]
    enc = label_encode(df, d, out_col="label")
    feats, names, _ = assemble_features(enc.drop("target"), "label")
    m = models.fit_model(feats, "decision_tree_classifier", {}, "classification")
    out = label_decode(models.predict(m, feats), d, "yhat", "yhat_label")
    assert set(r["yhat_label"] for r in out.collect()) <= {"cat", "dog"}


def test_cross_validate(spark):
    df = _regression(spark, 60)
    scores = models.cross_validate(df, ["row_id"], "linear_forecast", {}, "regression", k=2)
    assert scores.count() == 2 and all(r["score"] > 0.9 for r in scores.collect())


def test_csv_reading_and_dispatch(spark):
    d = tempfile.mkdtemp(prefix="tp-io-")
    utf = os.path.join(d, "b_data.csv")
    with open(utf, "w", encoding="utf-8") as f:
        f.write("姓名,年龄\n张三,20\n李四,30\n")
    df = io.read_table(spark, utf)
    assert df.columns == ["姓名", "年龄"] and df.count() == 2
    gbk = os.path.join(d, "c_gbk.csv")
    with open(gbk, "wb") as f:
        f.write("名字,分数\n王五,88\n".encode("gbk"))
    assert io.detect_csv_encoding(spark, gbk) == "gbk"
    assert io.read_table(spark, gbk).first()[0] == "王五"
    with open(os.path.join(d, "a_notes.xyz"), "w") as f:
        f.write("x")
    assert io.read_first_supported(spark, d).count() == 2
    with pytest.raises(ValueError):
        io.read_table(spark, os.path.join(d, "a_notes.xyz"))


def test_split_and_model_persistence(spark):
    d = tempfile.mkdtemp(prefix="tp-persist-")
    tr = spark.createDataFrame([([1.0, 2.0], 0), ([3.0, 4.0], 1)], "features array<double>, label int")
    te = spark.createDataFrame([([5.0, 6.0], 0)], "features array<double>, label int")
    io.save_split(tr, te, {"task_type": "classification", "n_classes": 2, "feature_names": ["a", "b"], "junk": 1}, d)
    a, b, meta = io.load_split(spark, d)
    assert a.count() == 2 and b.count() == 1 and meta["feature_names"] == ["a", "b"] and "junk" not in meta
    assert io.load_split(spark, os.path.join(d, "missing")) is None
    assert models.load_model(os.path.join(d, "none")) is None


def test_m4_lookup(spark):
    df = spark.createDataFrame([("Y1", "Yearly", [1.0, float("nan")]), ("H1", "Hourly", [2.0])],
                               "M4id string, SP string, values array<double>")
    got = {r["M4id"]: (r["horizon"], r["frequency"]) for r in io.m4_lookup(df).collect()}
    assert got == {"Y1": (6, 1), "H1": (48, 24)}
    assert io.m4_select_group(df, "Yearly").first()["values"] == [1.0]


def test_fit_on_batch_apply_on_stream(spark):
    from tidepool.operators.scale import fit_scaler

    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "ts", "value")
    params = fit_scaler(ev, ["value"], "minmax")
    batch = prepare_rows(ev, scaler=params, time_col="ts", granularity="hour")
    full = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    src = spark.readStream.schema(full).option("pathGlobFilter", "events.parquet").parquet(SF_SMALL)
    stream = prepare_rows(src.select("event_id", "ts", "value"), scaler=params, time_col="ts", granularity="hour")
    q = stream_to_table(stream, "tp_stream_check")
    q.awaitTermination()
    got = spark.sql("select * from tp_stream_check")
    assert got.count() == batch.count()
    assert got.exceptAll(batch).count() == 0


def test_model_scoring_on_a_stream(spark):
    """Fit on batch, score a file-source stream: the streamed predictions equal batch scoring."""
    full = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    feats = full.select("event_id", F.array(F.col("value"), F.col("user_id").cast("double")).alias("features"),
                        (F.col("value") * 2).alias("label"))
    m = models.fit_model(feats, "decision_tree_regressor", {"max_depth": 3}, "regression")
    batch = models.predict(m, feats).select("event_id", "yhat")
    src = spark.readStream.schema(full.schema).option("pathGlobFilter", "events.parquet").parquet(SF_SMALL)
    sfeats = src.select("event_id", F.array(F.col("value"), F.col("user_id").cast("double")).alias("features"))
    q = stream_to_table(models.predict(m, sfeats).select("event_id", "yhat"), "tp_stream_scores")
    q.awaitTermination()
    got = spark.sql("select * from tp_stream_scores")
    assert got.count() == batch.count() and got.exceptAll(batch).count() == 0


def test_history_and_model_files(spark):
    d = tempfile.mkdtemp(prefix="tp-hist-")
    h = spark.createDataFrame([(1, 0.5, 0.6, 0.1, 0.2, 1.0), (2, 0.25, 0.3, 0.2, 0.3, 3.0)],
                              "epoch int, train_loss double, val_loss double, train_metric double, val_metric double, "
                              "seconds double")
    io.write_history(h, os.path.join(d, "history"))
    assert spark.read.option("header", True).csv(os.path.join(d, "history")).count() == 2
    from tidepool.operators.evaluate import training_history

    s = training_history(h).first()
    assert s["final_train_loss"] == 0.25 and s["avg_epoch_seconds"] == 2.0 and s["epochs"] == 2
    df = _regression(spark, 40)
    m = models.fit_model(df, "decision_tree_regressor", {"max_depth": 3}, "regression")
    models.save_model(m, os.path.join(d, "model"))
    back = models.load_model(os.path.join(d, "model"))
    a = [r["yhat"] for r in models.predict(m, df).orderBy("row_id").collect()]
    b = [r["yhat"] for r in models.predict(back, df).orderBy("row_id").collect()]
    assert a == b


def test_ragged_trigger_and_series_lengths(spark):
    from tidepool.operators.clean import ragged_dimensions

    df = spark.createDataFrame([(0, [1.0, 2.0], [1.0]), (1, [1.0], [2.0])], "sample_id int, d0 array<double>, d1 array<double>")
    lens = io.series_lengths(df, "sample_id", ["d0", "d1"]).orderBy("sample_id").collect()
    assert [r["ragged"] for r in lens] == [True, False] and lens[0]["length"] == 2
    long = io.series_arrays_to_long(df, "sample_id", ["d0"])
    assert long.count() == 3
    per_dim = spark.createDataFrame([(0, "d0", 2), (0, "d1", 1)], "sample_id int, dim string, length int")
    assert ragged_dimensions(per_dim)


def test_model_parameters_follow_their_schema(spark):
    assert models.coerce_params({"n_estimators": "12", "max_depth": "None", "min_samples_leaf": 3.0}, "xgboost_regressor") == {
        "n_estimators": 12, "max_depth": None, "min_samples_leaf": 3}
    for name, bad in (("decision_tree_regressor", {"n_estimators": 3}), ("gbt_classifier", {"max_depth": "deep"}), ("gbt_classifier", {"max_depth": 2.5})):
        with pytest.raises(ValueError):
            models.coerce_params(bad, name)
    with pytest.raises(ValueError):
        models.build_estimator("decision_tree_regressor", {"max_depth": 31}, "regression")
    assert set(models.PARAMS) == set(models.REGISTRY) | set(models.BOOSTERS)


def test_recorded_runs_and_cv_report(spark, tmp_path):
    from datetime import datetime

    from tidepool.operators import runs

    path = str(tmp_path / "runs")
    for i in range(3):
        runs.record_run(spark, path, "p", f"m{i}", "gbt_regressor", "regression", "y", {"r2": i / 10}, created_at=datetime(2024, 1, i + 1))
    latest = runs.latest_runs(spark.read.parquet(path)).where("is_active").first()
    assert latest["run_id"] == "m2" and latest["metrics"] == {"r2": 0.2}
    scores = spark.createDataFrame([(0, 0.5), (1, 0.7)], "fold int, score double")
    assert models.cv_report(scores) == {"cv_scores": [0.5, 0.7], "mean_score": 0.6, "std_score": 0.1, "n_splits": 2}


def test_missing_and_broken_artefacts(spark, tmp_path):
    assert models.load_model(str(tmp_path / "none")) is None and io.load_split(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad").mkdir()
    with pytest.raises(Exception):
        models.load_model(str(tmp_path / "bad"))


def test_ingest_of_charsets_line_ends_and_nan(spark, tmp_path):
    import math

    text = "name,v\n{},1.5\n{},NaN\n"
    for enc, names in (("latin-1", ("café", "é")), ("gbk", ("数据", "表")), ("gb18030", ("㐀", "数")), ("utf-8", ("漢", "😀"))):
        f = tmp_path / f"{enc}.csv"
        f.write_bytes(text.format(*names).encode(enc))
        rows = io.read_table(spark, str(f)).collect()
        assert [r["name"] for r in rows] == list(names), enc
        assert rows[0]["v"] == 1.5 and rows[1]["v"] is None and not any(isinstance(r["v"], float) and math.isnan(r["v"]) for r in rows)
    f = tmp_path / "lines.csv"
    f.write_bytes('a,b\n"one\ntwo ""x""",1\n三,2\n'.encode("gb18030"))
    assert [(r["a"], r["b"]) for r in io.read_table(spark, str(f)).collect()] == [('one\ntwo "x"', 1), ("三", 2)]
    (tmp_path / "none.csv").write_bytes(b"a\n\xff\n")
    with pytest.raises(ValueError):
        io.read_table(spark, str(tmp_path / "none.csv"), encodings=["utf-8", "gbk"])
