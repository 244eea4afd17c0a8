"""Series formulas on rows, against the formulas on arrays in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import long_series as ls


def series_table(spark, lengths, seed=1):
    rnd = np.random.default_rng(seed)
    data = {f"s{k}" if k else None: rnd.normal(size=n) + np.sin(np.arange(n) / 3) for k, n in enumerate(lengths)}
    rows = [(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "k string, i bigint, x double").repartition(4), data


def by_key(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r["k"], []).append(tuple(r[c] for c in cols))
    return {k: np.array(sorted(v)) for k, v in out.items()}


def averages(x, k):
    padded = np.r_[[x[0]] * (k // 2), x, [x[-1]] * (k // 2)]
    return np.convolve(padded, np.ones(k) / k, "valid")


LENGTHS = (1, 2, 7, 500, 40)


@pytest.mark.parametrize("bucket_rows", [None, 16])
def test_centred_frames(spark, bucket_rows):
    df, data = series_table(spark, LENGTHS)
    got = by_key(ls.decompose_rows(df, "x", [1, 5, 9], ["i"], ["k"], bucket_rows=bucket_rows), "i", "trend", "seasonal")
    steps = by_key(ls.difference_rows(df, "x", ["i"], ["k"], 0.5, bucket_rows=bucket_rows), "i", "difference")
    for k, x in data.items():
        trend = np.mean([averages(x, w) for w in (1, 5, 9)], axis=0)
        assert np.allclose(got[k][:, 1], trend) and np.allclose(got[k][:, 2], x - trend)
        assert np.allclose(steps[k][:, 1], np.diff(x, prepend=0.5))


@pytest.fixture
def uncoalesced(spark):
    """Partitions stay as they are dealt, so that the tasks of small tests show how rows are spread."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield spark
    spark.conf.unset(name)


def test_frames_with_missing_values_and_without_series(spark):
    rows = [(i, None if i == 4 else float("nan") if i == 12 else float(i * i)) for i in range(20)]
    df = spark.createDataFrame(rows, "i bigint, x double")
    got = {r.i: r.trend for r in ls.moving_average_rows(df, "x", 3, ["i"], bucket_rows=6).collect()}
    assert {i for i, v in got.items() if v is None} == {3, 4, 5, 11, 12, 13} and got[0] == pytest.approx(1 / 3) and got[8] == pytest.approx((49 + 64 + 81) / 3)
    with pytest.raises(ValueError):
        ls.moving_average_rows(df, "x", 4, ["i"])
    assert ls.moving_average_rows(df.limit(0), "x", 3, ["i"]).collect() == []


@pytest.mark.parametrize("bucket_rows,runs", [(None, 4096), (8, 4096), (8, 3)])
def test_recurrences(spark, monkeypatch, bucket_rows, runs):
    monkeypatch.setattr(ls, "RUN_BUCKETS", runs)
    df, data = series_table(spark, (3, 8, 8, 400, 16, 1))
    got = by_key(ls.exp_smooth_rows(df, "x", 0.2, ["i"], ["k"], 0.25, bucket_rows=bucket_rows), "i", "level")
    level = ls.level_smooth_rows(df, "x", F.col("x") * 0.5, F.col("x") * 0.1, 0.2, ["i"], ["k"], 0.25, bucket_rows=bucket_rows)
    levels = by_key(level, "i", "level")
    for k, x in data.items():
        s = t = 0.25
        for i, v in enumerate(x):
            s, t = 0.8 * s + 0.2 * v, 0.8 * t + 0.2 * (v - 0.5 * v) + 0.8 * 0.1 * v
            assert got[k][i, 1] == pytest.approx(s) and levels[k][i, 1] == pytest.approx(t)
    trend = by_key(ls.damped_trend_rows(df, "x", 0.9, 3, ["i"], ["k"]), "step", "trend")
    assert all(np.allclose(trend[k][:, 1], x[-1] * np.cumsum(0.9 ** np.arange(1, 4))) for k, x in data.items())


def test_a_hot_series_is_smoothed_by_many_tasks(spark, uncoalesced):
    df = spark.range(40_000).select("id", F.lit("hot").alias("k"), F.sin("id").alias("x"))
    out = ls.exp_smooth_rows(df, "x", 0.1, ["id"], ["k"], bucket_rows=1000).withColumn("p", F.spark_partition_id())
    parts = out.groupBy("p").count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) <= 20_000 and all(r["count"] % 1000 == 0 for r in parts)
    rows = sorted((r.id, r.x, r.level) for r in out.collect())
    s = 0.0
    for _, x, level in rows:
        s = 0.9 * s + 0.1 * x
        assert abs(level - s) < 1e-9


def test_missing_gains_leave_the_state(spark):
    df = spark.createDataFrame([(i, None if i in (0, 3, 4) else 1.0 + i) for i in range(9)], "i bigint, x double")
    got = [r.level for r in ls.exp_smooth_rows(df, "x", 0.5, ["i"], v0=2.0, bucket_rows=2).orderBy("i").collect()]
    s, expected = 2.0, []
    for i in range(9):
        s = s if i in (0, 3, 4) else 0.5 * s + 0.5 * (1.0 + i)
        expected.append(s)
    assert got == pytest.approx(expected)


def test_affine_scan():
    rnd = np.random.default_rng(2)
    a, c, s = rnd.normal(size=777), rnd.normal(size=777), 0.0
    a[::50] = 0
    for t, v in enumerate(ls.affine_scan(a, c)):
        s = a[t] * s + c[t]
        assert v == pytest.approx(s, rel=1e-9)


@pytest.mark.parametrize("segment_rows", [1 << 16, 5])
def test_spectra(spark, segment_rows):
    df, data = series_table(spark, (1, 2, 7, 64, 97, 250))
    got = by_key(ls.spectrum_rows(df, "x", ["i"], ["k"], segment_rows), "f", "re", "im")
    for k, x in data.items():
        y = np.fft.rfft(x)
        assert np.allclose(got[k][:, 1], y.real) and np.allclose(got[k][:, 2], y.imag, atol=1e-9)
    top = by_key(ls.top_frequencies_rows(df, "x", 3, ["i"], ["k"], segment_rows), "rank", "freq", "amplitude", "phase")
    ahead = by_key(ls.fourier_extrapolate_rows(df, "x", 3, 4, ["i"], ["k"], segment_rows), "t", "seasonal")
    low = by_key(ls.lowpass_rows(df, "x", 5, ["i"], ["k"], segment_rows=segment_rows), "t", "smooth")
    for k, x in data.items():
        n, y = len(x), np.fft.rfft(x)
        f = np.arange(1, (n + 1) // 2)
        best = f[np.argsort(-np.abs(y[f]), kind="stable")[:3]]
        assert len(best) == len(top.get(k, ()))
        if len(best):
            assert np.allclose(top[k][:, 1:], np.c_[best / n, np.abs(y[best]), np.angle(y[best])])
        t = np.arange(n + 4)
        wave = sum((2 / n * (y[b] * np.exp(2j * np.pi * b * t / n)).real for b in best), np.zeros(n + 4))
        assert np.allclose(ahead[k][:, 1], wave)
        y[min(5, n // 2):] = 0
        assert np.allclose(low[k][:, 1], np.fft.irfft(y, n))


def test_spectrum_of_a_long_series(spark, uncoalesced):
    """A million rows equal numpy's transform, and no task holds more than a part of them."""
    n = 1_000_003  # a prime
    df = spark.range(n, numPartitions=8).select("id", (F.sin(F.col("id") / 7) + F.cos(F.col("id") * F.col("id") % 1013)).alias("x"))
    x = df.orderBy("id").toPandas()["x"].to_numpy()
    out = ls.spectrum_rows(df, "x", ["id"])
    y = out.orderBy("f").toPandas()
    exact = np.fft.rfft(x)
    assert len(y) == len(exact) and np.abs(y["re"] + 1j * y["im"] - exact).max() < 1e-6 * np.abs(exact).max()
    sizes = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 4 and max(r["count"] for r in sizes) < 0.5 * n


@pytest.mark.parametrize("segment_rows,max_lag", [(None, 600), (16, 9), (50, 30)])
def test_lags(spark, segment_rows, max_lag):
    df, data = series_table(spark, (1, 2, 7, 300, 41))
    got = by_key(ls.autocorrelation_rows(df, "x", max_lag, ["i"], ["k"], segment_rows), "lag", "corr")
    top = by_key(ls.top_lags_rows(df, "x", 1.5, max_lag, ["i"], ["k"], segment_rows), "rank", "lag", "weight")
    delayed = by_key(ls.time_delay_aggregate_rows(df, "x", 1.5, max_lag, ["i"], ["k"], segment_rows), "t", "delayed")
    for k, x in data.items():
        corr = np.array([np.dot(x, np.roll(x, -lag)) for lag in range(min(max_lag + 1, len(x)))])
        assert np.allclose(got[k][:, 1], corr)
        best = np.argsort(-np.round(corr, 9), kind="stable")[:max(1, int(1.5 * np.log(len(x))))]
        weights = np.exp(corr[best] - corr[best].max())
        weights /= weights.sum()
        assert np.allclose(sorted(top[k][:, 2]), sorted(weights))
        if k is not None and len(x) > 7:
            assert np.allclose(delayed[k][:, 1], sum(w * np.roll(x, -b) for w, b in zip(weights, best)))
