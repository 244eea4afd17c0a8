import math

import pytest
from pyspark.sql import functions as F

from tidepool.operators import clean


def _f2(spark):
    return spark.createDataFrame([(1.0, "a", 10.0), (2.0, "b", 20.0), (3.0, None, 30.0), (None, "b", 40.0), (5.0, "a", 50.0)],
                                 "num double, cat string, target double").withColumn("id", F.monotonically_increasing_id())


def test_fill_mean_and_mode(spark):
    out = clean.fill_missing(_f2(spark), "auto").orderBy("id").collect()
    assert out[3]["num"] == pytest.approx(2.75)
    assert all(r["cat"] is not None for r in out)
    assert out[2]["cat"] == "a"  # a and b tie at 2: smallest wins


def test_fill_constant_and_fallthroughs(spark):
    out = clean.fill_missing(_f2(spark), "constant", fill_value=99).orderBy("id").collect()
    assert out[3]["num"] == 99 and out[2]["cat"] == "99"
    # numeric + mode → mean, string + ffill → mode
    out = clean.fill_missing(_f2(spark), "mode").orderBy("id").collect()
    assert out[3]["num"] == pytest.approx(2.75)
    with pytest.raises(KeyError):
        clean.fill_missing(_f2(spark), "mean", ["nope"])


def test_all_null_string_column_becomes_unknown(spark):
    df = spark.createDataFrame([(None,), (None,)], "s string")
    assert {r["s"] for r in clean.fill_mode(df).collect()} == {"Unknown"}


def test_ffill_bfill(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None), (2, None), (3, 4.0)], "i int, a double")
    f = [r["a"] for r in clean.fill_forward(df, ["a"], ["i"]).orderBy("i").collect()]
    b = [r["a"] for r in clean.fill_backward(df, ["a"], ["i"]).orderBy("i").collect()]
    assert f == [1, 1, 1, 4] and b == [1, 4, 4, 4]
    lead = spark.createDataFrame([(0, None), (1, 2.0), (2, None)], "i int, a double")
    assert [r["a"] for r in clean.fill_forward(lead, ["a"], ["i"]).orderBy("i").collect()] == [None, 2.0, 2.0]


def test_drop_duplicates_and_columns(spark):
    f3 = spark.createDataFrame([(1, 10), (1, 10), (2, 20)], "a int, b int")
    assert clean.drop_duplicates(f3).count() == 2
    assert clean.duplicate_report(f3).first()["removed"] == 1
    f4 = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert clean.drop_columns(f4, ["a", "c"])[0].columns == ["b"]
    f5 = spark.createDataFrame([(1,)], "a int")
    out, report = clean.drop_columns(f5, ["a", "zzz"])
    assert out.columns == ["a"] and report == [("a", "kept_last_column", 1)]


def test_iqr(spark):
    f6 = spark.createDataFrame([(v,) for v in [1.0, 2.0, 3.0, 4.0, 100.0]], "val double")
    out, report = clean.iqr_filter(f6)
    assert out.count() < 5 and report[0][:2] == ("val", "outside_fences")
    f7 = spark.createDataFrame([(5.0,)] * 4, "val double")
    assert clean.iqr_filter(f7)[0].count() == 4
    withnull = spark.createDataFrame([(v,) for v in [1.0, 2.0, 3.0, 4.0, 100.0, None]], "val double")
    assert clean.iqr_filter(withnull)[0].where(F.col("val").isNull()).count() == 0


def test_iqr_is_sequential(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    a = np.concatenate([rng.normal(size=60), [15.0, -12.0]])
    b = np.concatenate([rng.normal(size=60) * 3, [0.0, 40.0]])
    rows = list(zip(a.tolist(), b.tolist()))
    keep = np.ones(len(rows), bool)
    for col in (a, b):  # expected: each column's quartiles over the rows kept so far
        v = col[keep]
        q1, q3 = np.quantile(v, [0.25, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        mask = keep & (col >= lo) & (col <= hi)
        if 0 < keep.sum() - mask.sum() < keep.sum():
            keep = mask
    df = spark.createDataFrame(rows, "a double, b double")
    out, report = clean.iqr_filter(df, 1.5, ["a", "b"])
    assert out.count() == int(keep.sum()) and len(report) == 2


def test_interpolate_and_nonfinite(spark):
    df = spark.createDataFrame([(0, None), (1, 1.0), (2, None), (3, None), (4, 4.0), (5, None)], "i int, a double")
    got = [r["a"] for r in clean.interpolate_linear(df, ["a"], ["i"]).orderBy("i").collect()]
    assert got == pytest.approx([1.0, 1.0, 2.0, 3.0, 4.0, 4.0])
    nf = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (2.0,)], "a double")
    z = [r["a"] for r in clean.nan_to_zero(nf).collect()]
    assert z[0] == 0 and z[1] > 1e308 and z[2] < -1e308 and z[3] == 0 and z[4] == 2
    n = [r["a"] for r in clean.nonfinite_to_null_all(nf).collect()]
    assert n[:4] == [None] * 4 and not math.isnan(n[4])


def test_subsample(spark):
    df = spark.range(10).select(F.lit(1).alias("s"), F.col("id"))
    assert clean.subsample(df, ["id"], ["s"], limit=5, factor=2).count() == 5
    assert clean.subsample(df, ["id"], ["s"], limit=50, factor=2).count() == 10
