from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidepool.operators import models
from tidepool.sources import io, store
from tidepool.streaming import apply


def test_a_killed_writer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root, a, b = str(tmp_path / "split"), spark.range(5).toDF("x"), spark.range(7).toDF("x")
    assert io.load_split(spark, root) is None and store.versions(spark, root) == []
    io.save_split(a, a, {"seq_len": 3, "other": 1}, root)

    def killed(*_):
        raise KeyboardInterrupt

    for step in ("_manifests", "_files"):  # after the sides are written; before the manifest is
        with monkeypatch.context() as m:
            m.setattr(store, step, killed)
            with pytest.raises(KeyboardInterrupt):
                io.save_split(b, b, {"seq_len": 9}, root)
    train, test, meta = io.load_split(spark, root)
    assert (train.count(), test.count(), meta) == (5, 5, {"seq_len": 3})
    with pytest.raises(Exception, match="boom"):
        io.save_split(b, b.select(F.raise_error(F.lit("boom")).alias("x")), {}, root)  # train is stored, test is not
    assert io.load_split(spark, root)[0].count() == 5
    io.save_split(b, a, {"seq_len": 4}, root)
    train, test, meta = io.load_split(spark, root)
    assert (train.count(), test.count(), meta["seq_len"]) == (7, 5, 4) and [v.number for v in store.versions(spark, root)] == [1, 2]


def test_half_a_manifest_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "s")
    io.save_split(spark.range(1), spark.range(1), {}, root)
    (tmp_path / "s" / "manifests" / ".000000000009-x.json.part").write_text('{"number": 9')
    assert store.current(spark, root).number == 1


def test_a_model_and_its_run_appear_together(spark, tmp_path):
    root = str(tmp_path / "models")
    assert store.current_model(spark, root) is None and store.runs_table(spark, root).collect() == []
    df = spark.createDataFrame([([float(i)], float(i % 2)) for i in range(20)], "features array<double>, label double")
    for name, depth in (("decision_tree_regressor", 1), ("lightgbm_regressor", 2)):
        model = models.fit_model(df, name, {"max_depth": depth}, "regression")
        store.publish_model(model, root, "p", name, "regression", "label", {"r2": depth / 4}, created_at=datetime(2024, 1, depth))
    model, run = store.current_model(spark, root)
    assert run["model_type"] == "lightgbm_regressor" and models.predict(model, df).count() == 20
    table = store.runs_table(spark, root)
    rows = {r.model_type: r for r in table.collect()}
    assert len(rows) == 2 and rows["decision_tree_regressor"].metrics == {"r2": 0.25} and rows["lightgbm_regressor"].created_at == datetime(2024, 1, 2)
    from tidepool.operators.runs import latest_runs

    assert [r.model_type for r in latest_runs(table.drop("folder")).where("is_active").collect()] == ["lightgbm_regressor"]


SCHEMA = "id long, v string, at timestamp"


def add_file(spark, folder, number, rows):
    spark.createDataFrame([(i, v, datetime(2024, 1, 1, h, m)) for i, v, h, m in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/part={number}")


def run_once(spark, folder, out, checkpoint):
    stream = apply.distinct_stream(apply.file_stream(spark, f"{folder}/*", SCHEMA, max_files=1), "at", "2 hours", ["id", "v"])
    query = apply.stream_to_table(stream, "distinct", "parquet", out, checkpoint)
    query.awaitTermination(120)
    return sorted((r.id, r.v, r.at.hour) for r in spark.read.schema(SCHEMA).parquet(out).collect())


def test_distinct_on_a_stream_with_late_rows_and_a_restart(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    add_file(spark, folder, 0, [(1, "a", 1, 0), (1, "a", 1, 5), (2, None, 1, 0), (2, None, 1, 30)])
    first = run_once(spark, folder, out, checkpoint)
    assert [(i, v) for i, v, _ in first] == [(1, "a"), (2, None)]
    add_file(spark, folder, 1, [(1, "a", 2, 0), (3, "c", 2, 30), (1, "b", 2, 0)])  # a repeated key after a restart
    second = run_once(spark, folder, out, checkpoint)
    assert [(i, v) for i, v, _ in second] == [(1, "a"), (1, "b"), (2, None), (3, "c")]
    add_file(spark, folder, 2, [(9, "z", 12, 0)])  # the watermark passes all keys
    run_once(spark, folder, out, checkpoint)
    add_file(spark, folder, 3, [(8, "late", 3, 0), (1, "a", 12, 30), (9, "z", 12, 40)])
    last = [(i, v) for i, v, _ in run_once(spark, folder, out, checkpoint)]
    assert (8, "late") not in last and last.count((1, "a")) == 2 and last.count((9, "z")) == 1
