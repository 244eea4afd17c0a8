import zlib
from itertools import combinations

import numpy as np

from tidepool.llm import quality

from ..conftest import SF_CHECK, SF_SMALL
from .helpers import AWKWARD, documents, with_clashes


def labels(spark, rows):
    return with_clashes(spark.createDataFrame(rows, "doc_id bigint, quality int"))


def training(spark):
    good = [(i, f"the quick brown fox number {i} walks, slowly and calmly, to the river bank.") for i in range(0, 200, 2)]
    junk = [(i, f"BUY!! NOW!! {i} $$$ " * 5) for i in range(1, 201, 2)]
    return good + junk, labels(spark, [(i, 1 - i % 2) for i in range(200)] + [(None, 1), (3, None), (5, 0)])


def test_pairwise_identity():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=9).astype(np.float32), rng.normal(size=(9, 4)).astype(np.float32), np.zeros(1), np.ones(1))
    x = rng.normal(size=(5, 9)).astype(np.float32)
    direct = [m.w0 + r @ m.w + sum(r[i] * r[j] * (m.v[i] @ m.v[j]) for i, j in combinations(range(9), 2)) for r in x]
    assert np.allclose(m.margin(x), direct, atol=1e-4)


def test_gradient_reaches_a_pairwise_pattern():
    # exclusive or: no linear score can do it
    x = np.array([[a, b] for a in (0, 1) for b in (0, 1)] * 100, dtype=np.float32)
    y = (x[:, 0] != x[:, 1]).astype(float)
    m = quality.fit_machine(x, np.zeros((len(x), 1)), y, epochs=200)
    assert ((m.score(m.rows(x, np.zeros((len(x), 1)))) >= 0.5) == (y == 1)).all()


def test_statistics_read_the_tail_of_a_long_text():
    for text, share in (("clean " * 6000 + "junk!! " * 6000, 0.5), ("junk!! " * 6000 + "clean " * 2000, 0.75), ("a. b", 0.5), ("", 0.0)):
        _, stats = quality.Features(8)(text, None)
        assert stats[quality.STATS.index("odd_endings")] == share


def test_learns_and_scores_awkward_rows(spark):
    rows, marks = training(spark)
    machine = quality.fit_quality(documents(spark, rows), marks)
    found = {r.doc_id: r for r in quality.score_quality(documents(spark, rows), machine).collect()}
    assert all(found[i].predicted == 1 - i % 2 for i, _ in rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    odd = quality.score_quality(documents(spark, AWKWARD), machine).collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in odd)
    assert [r.held_out for r in odd if r.doc_id is None] == [False, False]
    assert quality.score_quality(documents(spark, AWKWARD).limit(0), machine).collect() == []
    docs = documents(spark, rows)
    kept = quality.keep_quality(docs, machine)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, _ in sorted(rows) if i % 2 == 0]


def test_held_out_labels_are_never_read(spark):
    rows, marks = training(spark)
    fit = lambda m: quality.fit_quality(documents(spark, rows), m)
    wrong = marks.withColumn("quality", quality.F.when(quality.held_out("doc_id"), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = fit(marks), fit(wrong)
    assert a.w0 == b.w0 and (a.w == b.w).all() and (a.v == b.v).all()


def test_no_labels_and_one_class(spark):
    docs = documents(spark, AWKWARD)
    none = quality.fit_quality(docs, labels(spark, [(None, None)]))
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    one = quality.fit_quality(docs, labels(spark, [(1, 1), (2, 1), (7, 1)]))
    assert all(r.predicted == 1 for r in quality.score_quality(docs, one).collect())


def test_held_out_accuracy_of_the_query(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()}
    held = [r for r in quality.op3_quality(spark, SF_CHECK).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert quality.op3_quality(spark, SF_SMALL).columns == ["doc_id", "held_out", "score", "predicted"]
