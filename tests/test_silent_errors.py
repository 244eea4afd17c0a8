"""Cases that used to be wrong without a word: NaN as a value, null keys, text constants, streams of text."""

import pytest
from pyspark.sql import functions as F

from tidepool.operators import clean, evaluate, profile, split, timefeat, windows

NAN, INF = float("nan"), float("inf")


@pytest.fixture
def odd(spark):
    rows = [(i, v, s) for i, (v, s) in enumerate([(1.0, "a"), (NAN, "a"), (3.0, None), (None, "b"), (8.0, "a")])]
    return spark.createDataFrame(rows, "i int, x double, s string")


def test_nan_is_no_value(odd):
    d = profile.describe_numeric(odd, ["x"]).first()
    assert (d["count"], d["mean"], d["max"], d["p50"]) == (3, 4.0, 8.0, 3.0)
    assert profile.profile_nulls(odd).where("column = 'x'").first()["null_count"] == 2
    for fill, value in ((clean.fill_mean, 4.0), (clean.fill_median, 3.0), (clean.fill_zero, 0.0), (lambda df, c: clean.fill_constant(df, "7", c), 7.0)):
        out = fill(odd, ["x"])
        assert [r.x for r in out.orderBy("i").collect()] == [1.0, value, 3.0, value, 8.0]
        assert clean.fill_report(odd, out, ["x"]).first()["filled"] == 2
    assert [r.x for r in clean.fill_missing(odd, "ffill", ["x"], order_by=["i"]).orderBy("i").collect()] == [1.0, 1.0, 3.0, 3.0, 8.0]


def test_histogram_leaves_out_what_has_no_bin(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, 4.0, NAN, INF, -INF, None)], "x double")
    rows = profile.histogram(df, ["x"], 4).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [1, 1, 1, 1] and (rows[0].lo, rows[-1].hi) == (0.0, 4.0)


def test_constants_given_as_text(odd):
    holes = odd.withColumn("i", F.when(F.col("i") != 2, F.col("i")))
    assert sorted(r.i for r in clean.fill_missing(holes, "constant", ["i"], "9").collect()) == [0, 1, 3, 4, 9]
    assert sorted(r.i for r in clean.fill_missing(holes, "constant", ["i"], " 2.5 ").collect()) == [0.0, 1.0, 2.5, 3.0, 4.0]
    for fill in (lambda: clean.fill_missing(odd, "constant", ["x"], "none"), lambda: clean.fill_constant(odd, "none", ["x", "s"])):
        with pytest.raises(ValueError, match="no number"):
            fill()
    assert clean.fill_constant(odd, "none").where("s = 'none'").count() == 1


def test_random_split_with_null_keys(spark):
    rows = [("1", None), (None, "1"), ("1", "1"), (None, None)] * 5 + [(str(i), None) for i in range(20)]
    df = spark.createDataFrame(rows, "a string, b string")
    train, test = split.random_split(df, ["a", "b"], 0.5, 42)
    assert (train.count(), test.count()) == (20, 20)
    assert sorted(r["count"] for r in split.kfold(df, ["a", "b"], 4).groupBy("fold").count().collect()) == [10, 10, 10, 10]
    numbers = spark.createDataFrame([(v,) for v in (NAN, None, 1.0, -INF) * 6], "x double")
    assert split.random_split(numbers, ["x"], 0.25, 1)[1].count() == 6


def test_time_encoding_of_text_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 05:00:00",), ("soon",)], "t string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t string").parquet(str(tmp_path / "in"))
    out, names, _ = timefeat.time_encoding(stream, "t", "hour")
    query = out.writeStream.format("memory").queryName("encoded").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    rows = {r.t: r for r in spark.table("encoded").collect()}
    assert "hour" in names and rows["2024-01-01 05:00:00"]["hour"] == pytest.approx(5 / 23) and rows["soon"]["hour"] is None
    with pytest.raises(ValueError):
        timefeat.time_encoding(stream, "t")


@pytest.mark.parametrize("gaps", [[60] * 3, [3600] * 4, [3599, 3601], [3598, 3601], [86400, 1, 86400], [60, 3000000, 3000000, 60], [2419200] * 5, [7]])
def test_granularity_follows_the_median_gap(spark, gaps):
    times = [0]
    for g in gaps:
        times.append(times[-1] + g)
    df = spark.createDataFrame([(float(t),) for t in times], "s double").select(F.timestamp_seconds("s").alias("t"))
    assert timefeat.infer_granularity(df, "t") == timefeat.granularity_from_gap(timefeat.median_gap_seconds(df, "t"))
    assert timefeat.infer_granularity(df.limit(1), "t") == "hour"


def test_confusion_matrix_and_padding_in_runs(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "LABEL_RUN", 3)
    df = spark.createDataFrame([(i % 8, i % 5) for i in range(40)] + [(None, 1)], "y int, yhat int")
    cells = {(r.truth, r.pred): r["count"] for r in evaluate.confusion_matrix(df).collect()}
    assert len(cells) == 81 and sum(cells.values()) == 41 and cells[None, 1] == 1 and cells[None, None] == 0
    monkeypatch.setattr(windows, "PAD_RUN", 4)
    rows = spark.createDataFrame([("a", i, 1.0) for i in range(11)] + [("b", 0, 2.0)], "k string, i int, x double")
    long = windows.pad_series_long(rows, ["k"], ["i"], ["x"])
    assert sorted(r.pos for r in long.where("k = 'b'").collect()) == list(range(11)) and long.where("not mask").count() == 10


def test_entry_without_the_corpus_operators(monkeypatch):
    import sys

    import __spark_entry__ as entry

    every = entry.queries()
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("tidepool.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)  # a library that they need is missing
    left = entry.queries()
    assert set(left) < set(every) and not any(n.startswith("op1") or n == "pipeline" for n in left) and len(left) > 140
