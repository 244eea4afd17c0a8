import hashlib
import random

import numpy as np
import pytest

from tidepool.llm import suffix_dedup as S

from ..conftest import SF_SMALL
from .helpers import AWKWARD, documents


def brute(rows, length=100):
    """rows in order: (doc_id, text)."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        cover = bytearray(len(raw))
        for at in range(len(raw) - length + 1):
            w = raw[at:at + length]
            if w in seen:
                cover[at:at + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, c in zip(raw, cover) if not c)
        out.append((i, len(raw), sum(cover), sum(1 for x in bytes(cover).split(b"\0") if x), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in df.collect()), key=str)


def passages(seed, n=90):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("ab é") for _ in range(300)) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randint(0, 250)
            parts.append(rnd.choice(base)[at:at + rnd.randint(5, 220)])
            if rnd.random() < 0.3:
                parts.append("x" * rnd.randint(1, 150))
            if rnd.random() < 0.3:
                parts.append("abcde" * rnd.randint(1, 60))
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("args", [dict(length=20, gram=5, long_gram=15, hot_runs=2, flush_records=300, sort_windows=200, group_bytes=2000),
                                  dict(length=20, gram=8, long_gram=20), dict(hot_runs=1)])
def test_against_brute_force(spark, args):
    rows = passages(len(str(args)))
    assert got(S.remove_repeats(documents(spark, rows), **args)) == brute(rows, args.get("length", 100))


def test_awkward_rows(spark):
    rows = [r for r in AWKWARD if r[0] is not None]
    assert got(S.remove_repeats(documents(spark, rows))) == brute(rows)


def test_rows_that_share_an_id_count_in_reading_order(spark):
    rows = [(None, "n" * 120 + "m"), (5, "k" * 60 + "l" * 60), (5, "k" * 60 + "l" * 60)]
    df = S.remove_repeats(documents(spark, rows))
    # the null id comes first; its windows of one letter repeat inside it
    assert [r.n_removed for r in df.filter("doc_id is null").collect()] == [119]
    fives = sorted(r.n_removed for r in df.filter("doc_id = 5").collect())
    assert fives == [0, 120]


def test_empty_table_and_parameters(spark):
    assert S.remove_repeats(documents(spark, AWKWARD).limit(0)).collect() == []
    with pytest.raises(ValueError):
        S.remove_repeats(documents(spark, AWKWARD), length=10, gram=11)


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    expected = [r[:5] for r in brute(rows)]
    assert sorted((tuple(r) for r in S.op2_suffix_dedup(spark, SF_SMALL).collect()), key=str) == expected


def test_merge_sort_orders_suffixes():
    rnd = random.Random(1)
    buffer = bytes(rnd.choice(b"ab") for _ in range(600))
    offsets = np.array([rnd.randrange(580) for _ in range(257)])
    s = S.Suffixes(buffer, offsets, 20, S.Powers())
    order = S.merge_sort(s, np.zeros(257, dtype=np.int64), np.full(257, 257))
    texts = [buffer[offsets[i]:offsets[i] + 20] for i in order]
    assert texts == sorted(texts) and sorted(order) == list(range(257))
    e, f = order[:-1], order[1:]
    common = [next((k for k in range(20) if x[k] != y[k]), 20) for x, y in zip(texts, texts[1:])]
    assert S.Suffixes(buffer, offsets, 20, S.Powers()).extension(e, f).tolist() == common


def test_colliding_hashes_are_caught(monkeypatch):
    monkeypatch.setattr(S, "prefix_hashes", lambda codes, powers: np.zeros(len(codes) + 1, dtype=np.uint64))
    buffer = b"aaaabaaaacaaaab"
    out = S.repeated_windows(buffer, np.array([0, 5, 10]), np.zeros(3, dtype=np.int64), np.arange(3), 5, S.Powers())
    assert out.tolist() == [False, False, True]


def test_bucket_is_that_of_spark(spark):
    from pyspark.sql import functions as F

    rows = [(-5, 0), (7, 3), (S.LOWEST, 1), (1 << 40, 9)]
    df = spark.createDataFrame(rows, "d bigint, t bigint").select("d", "t", F.pmod(F.xxhash64("d", "t"), F.lit(97)).alias("b"))
    mine = S.doc_bucket(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), 97)
    assert {(r.d, r.t): r.b for r in df.collect()} == {r: int(b) for r, b in zip(rows, mine)}


def boilerplate(n):
    """Texts of random letters around one passage."""
    rnd = random.Random(n)
    passage, noise = "".join(rnd.choices("abcdefgh ", k=180)), lambda: "".join(rnd.choices("abcdefgh ", k=rnd.randint(80, 160)))
    return [(i, noise() + passage + noise()) for i in range(n)]


def test_common_passage_in_different_surroundings(spark):
    rows = boilerplate(60)
    for args in (dict(hot_runs=8), dict(hot_runs=8, flush_records=500, group_bytes=3000)):
        assert got(S.remove_repeats(documents(spark, rows), **args)) == brute(rows)


def test_hot_windows_are_dealt_by_their_bytes():
    # one group of documents: a window leaves it once, and no bucket gets a record of every document
    rows, (length, n_buckets) = boilerplate(300), (100, 64)
    docs = S.pa.table({"doc_id": [i for i, _ in rows], "tie": [0] * len(rows), "text": [t for _, t in rows]})
    runs = [(a, i, 0, lo, x - lo, hi - lo, 1) for i, t in rows for c in S.anchored_runs(t.encode(), S.Powers(), length, S.GRAM)
            for a, x, lo, hi in zip(*(v.tolist() for v in c[:4]))]
    asked = {name: np.array(c, dtype=kind) for (name, kind), c in zip(S.REQUEST, zip(*runs))}
    packed = S._rows_of([("q_", asked, S.REQUEST, np.zeros(len(runs), dtype=np.int64))], S.SETTLED_ROWS)
    out = S._fetch(length, S.LONG_GRAM, n_buckets)(docs, S.pa.Table.from_batches(packed, schema=S.SETTLED_ROWS)).to_pylist()
    load = [sum(len(v) // 4 for k, v in r.items() if k in ("f_lo", "w_lo")) for r in out]
    distinct = {t[a:a + length] for _, t in rows for a in range(len(t) - length + 1)}
    assert sum(load) == len(distinct) and len(load) == n_buckets // 8 and max(load) < 1.5 * min(load)
