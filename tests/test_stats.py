import numpy as np
import pytest

from tidepool.operators.stats import exact_quantiles, mode_table


def test_exact_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(7)
    a = np.concatenate([np.full(500, 3.25), rng.normal(size=1000)])
    b = rng.integers(0, 5, size=1500).astype(float)
    rows = [(float(x), float(y) if i % 10 else None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, ["a", "b"], probs)
    assert got["a"] == pytest.approx(list(np.quantile(a, probs)))
    bb = np.array([r[1] for r in rows if r[1] is not None])
    assert got["b"] == pytest.approx(list(np.quantile(bb, probs)))
    agg = exact_quantiles(df, ["a", "b"], probs, method="agg")
    assert agg["a"] == pytest.approx(got["a"]) and agg["b"] == pytest.approx(got["b"])


def test_all_null_column_and_modes(spark):
    df = spark.createDataFrame([(None, "x"), (None, "y"), (None, "y")], "a double, s string")
    assert exact_quantiles(df, ["a"], [0.5]) == {"a": [None]}
    m = mode_table(df, ["s"]).first()
    assert (m["value"], m["freq"], m["unique"], m["count"]) == ("y", 2, 2, 3)
