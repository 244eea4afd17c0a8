import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import series, windows
from tidepool.plans.order import with_row_index


def _daily(spark, n, cols=("feat", "target")):
    rows = [(i, float(i), float(3 * i)) for i in range(n)]
    return spark.createDataFrame(rows, "i long, feat double, target double")


def test_sliding_window_shapes(spark):
    df = _daily(spark, 100)
    w = windows.sliding_windows(df, 10, 3, ["i"], ["feat", "target"], "target")
    assert w.count() == 100 - 10 - 3 + 1
    r = w.orderBy("window_id").first()
    assert len(r["x"]) == 10 and len(r["x"][0]) == 2 and r["y"] == [30.0, 33.0, 36.0]


def test_too_short_raises(spark):
    with pytest.raises(ValueError):
        windows.sliding_windows(_daily(spark, 5), 10, 1, ["i"], ["feat"], "target")


@pytest.mark.parametrize("label_len,pred_len,seq_len", [(0, 5, 10), (2, 5, 10), (5, 12, 24)])
def test_seq2seq_shapes(spark, label_len, pred_len, seq_len):
    df = _daily(spark, 60).withColumn("m", F.col("i") % 7)
    idx, n = with_row_index(df, ["i"])
    w = windows.seq2seq_windows_indexed(idx, seq_len, pred_len, label_len, ["feat", "target"], ["m"], "target", n=n)
    r = w.orderBy("window_id").first()
    assert len(r["x"]) == seq_len and len(r["dec_inp"]) == label_len + pred_len
    assert len(r["y_mark"]) == label_len + pred_len and len(r["y"]) == pred_len
    assert all(v == 0.0 for row in r["dec_inp"][label_len:] for v in row)


def test_strided_tiling_pad_last(spark):
    df = _daily(spark, 23)
    idx, _ = with_row_index(df, ["i"])
    assert windows.strided_windows_indexed(idx, 5, 3, ["feat"]).count() == (23 - 5) // 3 + 1
    assert windows.tiling_windows_indexed(idx, 5, ["feat"]).count() == 4
    two = df.select((F.col("i") % 2).alias("s"), "i", "feat")
    p = windows.pad_series(two, ["s"], ["i"], ["feat"], max_len=12).orderBy("s").collect()
    assert [r["length"] for r in p] == [12, 11] and p[1]["mask"][-1] is False
    lw = windows.last_window(two, ["s"], ["i"], "feat", 15).orderBy("s").collect()
    assert lw[0]["mask"][:3] == [0.0, 0.0, 0.0] and lw[0]["insample"][-1] == 22.0


def test_patch_and_tails(spark):
    df = spark.createDataFrame([([float(i) for i in range(10)],)], "x array<double>")
    p = df.select(windows.patch("x", 4, 4, windows.segment_padding(10, 4)).alias("p")).first()["p"]
    assert p == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 9, 9]]
    t = df.select(windows.multiscale_tails("x", [1, 2], 2).alias("t")).first()["t"]
    assert t == [[8, 9], [6, 7, 8, 9]]


def _arr(spark, x):
    return spark.createDataFrame([(list(map(float, x)),)], "x array<double>")


def test_decomposition_identity_and_edges(spark):
    x = np.random.default_rng(1).normal(size=24)
    d = _arr(spark, x).select(series.decompose("x", 5).alias("d")).first()["d"]
    assert np.allclose(np.array(d["seasonal"]) + np.array(d["trend"]), x)
    padded = np.concatenate([[x[0]] * 2, x, [x[-1]] * 2])
    assert np.allclose(d["trend"], np.convolve(padded, np.ones(5) / 5, mode="valid"))
    with pytest.raises(ValueError):
        series.moving_average("x", 4)


def test_smoothing_and_trend(spark):
    x = np.random.default_rng(2).normal(size=16)
    s = _arr(spark, x).select(series.exp_smooth("x", 0.3, 0.5).alias("s")).first()["s"]
    w, exp, prev = 0.7, [], 0.5
    for v in x:
        prev = w * prev + 0.3 * v
        exp.append(prev)
    assert np.allclose(s, exp)
    g = spark.createDataFrame([(2.0,)], "g double").select(series.damped_trend("g", 0.5, 3).alias("d")).first()["d"]
    assert g == pytest.approx([1.0, 1.5, 1.75])


def test_spectral_against_numpy(spark):
    x = np.random.default_rng(3).normal(size=32)
    df = _arr(spark, x)
    ac = df.select(series.autocorrelation("x").alias("a")).first()["a"]
    assert np.allclose(ac, [np.dot(x, np.roll(x, -k)) for k in range(32)])
    lp = df.select(series.lowpass("x", 32).alias("l")).first()["l"]
    spec = np.fft.rfft(x)
    spec[16:] = 0
    assert np.allclose(lp, np.fft.irfft(spec, n=32))
    keep = series.kept_modes(32, 4, "random", seed=3).tolist()
    assert len(keep) == 4 and keep == sorted(keep) and max(keep) < 16
    rl = df.select(series.lowpass("x", 4, "random", 3).alias("l")).first()["l"]
    spec = np.fft.rfft(x)
    kept = np.zeros_like(spec)
    kept[keep] = spec[keep]
    assert np.allclose(rl, np.fft.irfft(kept, n=32))
    fx = df.select(series.fourier_extrapolate("x", 3, 4).alias("f")).first()["f"]
    assert len(fx) == 36
    short = _arr(spark, [1.0, 2.0]).select(series.fourier_extrapolate("x", 3, 2).alias("f")).first()["f"]
    assert short == [0.0] * 4
    lags = df.select(series.top_lags(F.col("x"), 1.0, 32).alias("l")).first()["l"]
    assert len(lags) == int(math.log(32)) and sum(r["weight"] for r in lags) == pytest.approx(1.0)
