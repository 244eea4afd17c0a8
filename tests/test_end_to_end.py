"""The reference's general workflow end to end: upload → profile → clean → fill → split → fit →
evaluate → predict/export → cross-validate, on a CSV written from a driver table."""

import os
import tempfile

from pyspark.sql import functions as F

from tidepool.operators import clean, evaluate, features, models, profile, split
from tidepool.sources import io

from .conftest import SF_SMALL


def test_general_classification_workflow(spark):
    d = tempfile.mkdtemp(prefix="tp-e2e-")
    src = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_linestatus", "l_returnflag")
    src.coalesce(1).write.option("header", True).csv(os.path.join(d, "upload"))
    csv = [f for f in io.list_files(spark, os.path.join(d, "upload")) if f.endswith(".csv")][0]

    df = io.read_table(spark, csv)
    shape = profile.profile_shape(df).first()
    assert (shape["n_rows"], shape["n_cols"]) == (src.count(), 7)
    assert profile.profile_nulls(df).where(F.col("null_count") > 0).count() == 0

    df, _ = clean.drop_columns(clean.drop_duplicates(df), ["l_linenumber"])
    df = clean.fill_missing(df, "auto")
    df = df.withColumn("row_id", F.monotonically_increasing_id())
    task, k = features.infer_task(df, "l_returnflag")
    assert task == "classification" and k == 3

    target = features.fit_label_encoder(df, "l_returnflag")
    enc = features.label_encode(df, target, out_col="label").drop("l_returnflag")
    data, names, _ = features.assemble_features(enc, "label", exclude=["row_id", "l_orderkey"])
    assert names == ["l_quantity", "l_discount", "l_tax", "l_linestatus"]
    train, test = split.random_split(data, ["row_id"], 0.2)

    m = models.fit_model(train, "random_forest_classifier", {"n_estimators": 10, "max_depth": 5}, task, k)
    scored = models.predict(m, test)
    acc = evaluate.accuracy(scored, "label", "yhat").first()[0]
    assert 0.0 <= acc <= 1.0
    cm = evaluate.confusion_matrix(scored, "label", "yhat")
    assert cm.agg(F.sum("count")).first()[0] == test.count()
    prf = evaluate.precision_recall_f1(scored, "label", "yhat").first()
    assert all(0.0 <= prf[c] <= 1.0 for c in ("precision", "recall", "f1"))

    decoded = features.label_decode(scored.withColumnRenamed("row_id", "rid"), target, "yhat", "predicted")
    export = io.prediction_export(decoded.withColumnRenamed("rid", "row_id").withColumnRenamed("label", "y"))
    assert set(export.columns) == {"index", "true_value", "prediction", "confidence"}
    io.write_predictions(decoded.withColumnRenamed("rid", "row_id").withColumnRenamed("label", "y"),
                         os.path.join(d, "predictions"))
    assert spark.read.option("header", True).csv(os.path.join(d, "predictions")).count() == test.count()

    cv = models.cross_validate(data, ["row_id"], "decision_tree_classifier", {"max_depth": 4}, task, k=2, n_classes=k)
    summary = evaluate.cv_summary(cv).first()
    assert summary["folds"] == 2 and 0.0 <= summary["mean"] <= 1.0


def _hours(spark, n=200):
    from pyspark.sql import functions as F

    t = F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).cast("timestamp_ntz")
    return spark.range(n).select(F.col("id"), t.alias("t"), (F.col("id") % 24 + F.sin("id")).alias("v"),
                                 F.when(F.col("id") % 24 < 8, "night").otherwise("day").alias("part"))


def test_time_series_classification(spark):
    from tidepool.plans.flagship import prepare_time_series

    train, test, meta = prepare_time_series(_hours(spark), "t", "part", ["id"], seq_len=12, pred_len=2)
    assert (meta.task_type, meta.classes, meta.n_classes) == ("classification", ("day", "night"), 2)
    assert {v for r in train.select("y").collect() for v in r["y"]} == {0.0, 1.0}
    assert meta.target_scaler.method is None and test.count() == 40 - 14 + 1


def test_seq2seq_end_to_end(spark):
    from tidepool.plans.flagship import prepare_seq2seq

    train, test, meta = prepare_seq2seq(_hours(spark).drop("part"), "t", "v", ["id"], seq_len=12, pred_len=2, label_len=4)
    assert meta.feature_names[-1] == "v" and meta.granularity == "hour" and len(meta.encodings) == 5
    row = train.orderBy("window_id").first()
    assert len(row["x"]) == 12 and len(row["dec_inp"]) == 6 and len(row["y_mark"]) == 6 and len(row["y"]) == 2
    assert max(v for r in train.select("y").collect() for v in r["y"]) <= 1.0 and meta.target_scaler.method == "minmax"
    assert test.count() == 40 - 14 + 1


def test_ridge_matches_the_closed_form(spark):
    import numpy as np

    from tidepool.operators.models import fit_ridge

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5)) * [1, 10, 0.1, 3, 0] + [0, 5, 2, -1, 7]
    y = x @ rng.normal(size=(5, 3)) + rng.normal(size=(300, 3))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "features array<double>, y array<double>").repartition(4)
    model = fit_ridge(df, reg=0.05)
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    w = np.linalg.solve(z.T @ z / 300 + 0.05 * np.eye(5), z.T @ (y - y.mean(0)) / 300)
    expected = z @ w + y.mean(0)
    got = np.array([r["p"] for r in df.select(model.predict("features").alias("p")).collect()])
    assert np.allclose(np.sort(got, axis=0), np.sort(expected, axis=0))
