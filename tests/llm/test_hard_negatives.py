import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import hard_negatives

from ..conftest import SF_SMALL
from .helpers import with_clashes


def vectors(spark, rows):
    return with_clashes(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3))


def brute(rows, every=10, positives=3, negatives=4, percent=80, scale=256):
    kept = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            row = (label, [math.floor(scale * x) for x in v])
            kept[i] = min(row, kept.get(i, row))
    out = []
    for a, (label, v) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in kept.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [(t, i) for t, i, other in scored if other != label and percent * -s <= 100 * -t <= 100 * -s]
            out += [(a, p, rank, i, -s, -t) for rank, (t, i) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def mined(df, **more):
    given = {"every": 10, "positives": 3, "negatives": 4} | more
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, **given).collect())


def sample(n, seed, labels=3, dim=5, clusters=4):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(clusters)]
    return [(i, [c + rnd.gauss(0, .2) for c in rnd.choice(centres)], rnd.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("seed,group_rows,anchor_rows", [(1, 1 << 16, 1024), (2, 40, 4)])
def test_against_brute_force(spark, seed, group_rows, anchor_rows):
    rows = sample(200, seed)
    assert mined(vectors(spark, rows), group_rows=group_rows, anchor_rows=anchor_rows) == brute(rows) != []


def test_awkward_rows(spark):
    same, nan = [0.5, 0.25], float("nan")
    rows = [(0, same, 1), (1, same, 1), (2, same, 1), (3, same, 2), (4, same, 2), (5, same, 2), (5, same, 2), (5, [9.0, 9.0], 0), (6, None, 1),
            (7, [0.5, None], 1), (8, [0.5, nan], 2), (9, [float("inf"), 1.0], 1), (None, same, 1), (11, same, None), (10, [-0.5, -0.25], 1),
            (20, [0.0, 0.0], 1), (30, [], 1), (40, [0.5, 0.25, 1.0], 2), (-10, [0.4, 0.2], 2), (-11, [0.4, 0.2], 1), (50, [1e6, -3e5], 1)]
    assert mined(vectors(spark, rows)) == brute(rows) != []


def test_scores_beyond_exact_floats(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.uniform(-1, 1) * 2.0 ** 22 + rnd.random() for _ in range(4)], i % 2) for i in range(60)]
    assert mined(vectors(spark, rows)) == brute(rows) != []


def test_empty_table_and_no_anchor(spark):
    assert mined(vectors(spark, [(1, [1.0], 1)]).limit(0)) == []
    assert mined(vectors(spark, [(1, [1.0], 1), (2, [1.0], 2)])) == []


def test_a_label_and_a_vector_that_most_rows_share(spark):
    rows = sample(90, 3) + [(i, [0.3, 0.3, 0.3, 0.3, 0.3], 1) for i in range(90, 200)]
    assert mined(vectors(spark, rows), group_rows=50, anchor_rows=8) == brute(rows)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF_SMALL}/embeddings.parquet'")
    found, df = con.sql(hard_negatives.SQL), hard_negatives.op13_hard_negatives(spark, SF_SMALL)
    assert found.columns == df.columns
    assert sorted(found.fetchall()) == sorted(tuple(r) for r in df.collect())


def test_only_rows_inside_the_bounds_are_scored():
    rnd = np.random.default_rng(1)
    x = np.round(rnd.normal(size=(3, 8)) * 200)
    tree = hard_negatives.spanning_tree(x)
    assert sorted(tree[0]) == [0, 1, 2] and tree[1][0] == -1 and all(p < i for i, p in enumerate(tree[1]))
    tight = np.vstack([x[0], x[0] + np.eye(8)[0], x[0] + np.eye(8)[0] + np.eye(8)[1]])
    order, parent, length = hard_negatives.spanning_tree(tight)
    assert (order, parent, length) == ([0, 1, 2], [-1, 0, 1], [0.0, 1.0, 1.0])
    group = object.__new__(hard_negatives._Rows)
    group.x = group.whole = np.round(rnd.normal(size=(500, 8)) * 200).astype(np.int64)
    group.c = group.targets = tight.astype(np.int64)
    group.x, group.c, group.plain, group.ids = group.x.astype(float), group.c.astype(float), True, np.arange(500)
    group.norms = np.sqrt((group.x ** 2).sum(axis=1))
    exact, scored = group.x @ group.c.T, {0: 0, 1: 0, 2: 0}

    def wanted(i, rows, low, high):
        assert (low <= exact[rows, i]).all() and (exact[rows, i] <= high).all()
        return (high >= 60_000) & (low <= 80_000)

    def found(i, rows, scores):
        scored[i] += len(rows)
        assert (scores == exact[rows, i]).all()

    group.walk(parent, length, wanted, found)
    assert all(n < 250 for n in scored.values())


def test_label_expression(spark):
    rows = sample(40, 4)
    moved = [(i, v, (x + 1) % 3 if i % 7 == 0 else x) for i, v, x in rows]
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 3).otherwise(F.col("label"))
    assert mined(vectors(spark, rows), label=label) == brute(moved)
