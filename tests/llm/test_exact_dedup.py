import hashlib
import random
from collections import defaultdict

import duckdb
import pytest

from tidepool.llm import exact_dedup

from ..conftest import SF_SMALL
from .helpers import AWKWARD, documents


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        top = max(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, top, len(ids), sha) for i in ids]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("args", [{}, {"table_bytes": 64, "table_rows": 3}, {"hash_of": lambda raw: 7}, {"table_bytes": 200, "hash_of": lambda raw: len(raw) % 3}])
def test_awkward_rows_with_real_and_colliding_hashes(spark, args):
    df = exact_dedup.exact_groups(documents(spark, AWKWARD), **args)
    assert got(df) == brute(AWKWARD)
    kept = [r.text_sha256 for r in df.filter("kept").collect()]
    assert len(kept) == len(set(kept)) == len({t or "" for _, t in AWKWARD})


def test_recursive_partitioning_with_a_hot_text(spark):
    rnd = random.Random(2)
    rows = [(i, "hot" if i % 3 == 0 else f"text {rnd.randint(0, 150)} " * rnd.randint(1, 9)) for i in range(900)]
    df = documents(spark, rows)
    members = spark.createDataFrame([(i, i % 37, 10) for i in range(500)], "record bigint, hash bigint, n_bytes bigint")
    dealt, _ = exact_dedup._split_buckets(members, 400, 8)
    for r in dealt.groupBy("bucket").agg({"n_bytes": "sum", "hash": "count"}).collect():
        hashes = {x.hash for x in dealt.filter(dealt.bucket == r.bucket).select("hash").collect()}
        assert r["sum(n_bytes)"] <= 400 or len(hashes) == 1
    assert got(exact_dedup.exact_groups(df, table_bytes=2000, table_rows=50)) == brute(rows)


@pytest.mark.parametrize("hash_of", [exact_dedup.content_hash, lambda raw: len(raw) % 2])
def test_copies_of_a_hot_text_are_folded_before_they_meet(spark, hash_of):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 500), "hot " * 150 if i % 3 == 0 else f"text {i // 7}") for i in range(900)]
    rows += [(None, "hot " * 150), (501, "hot " * 150), (501, "hot " * 150)]
    seen = []

    def spy(records, folder, table_bytes, hash_of):
        seen.append(fold(records, folder, table_bytes, hash_of))
        return seen[-1]

    fold, exact_dedup._fold_hot = exact_dedup._fold_hot, spy
    try:
        df = exact_dedup.exact_groups(documents(spark, rows), table_bytes=2000, table_rows=2, hash_of=hash_of)
        assert got(df) == brute(rows)
        assert df.filter("kept").count() == len({t for _, t in rows})
    finally:
        exact_dedup._fold_hot = fold
    records, links = seen[0]
    copies = records.groupBy("text").agg({"n_bytes": "sum", "record": "count"}).collect()
    assert all(r["sum(n_bytes)"] <= 2000 or r["count(record)"] <= exact_dedup.FOLD for r in copies)
    assert links.count() == links.select("record").distinct().count() > 100


def test_empty_table(spark):
    assert exact_dedup.exact_groups(documents(spark, AWKWARD).limit(0)).collect() == []


def test_keep_one_keeps_columns_and_one_row_of_each_text(spark):
    docs = documents(spark, AWKWARD)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text or "") for r in kept.collect()]
    assert sorted(t for _, t in rows) == sorted({t or "" for _, t in AWKWARD})
    assert (6, "Some text, of words.") in rows and (2, "") not in rows and (3, "") in rows


def test_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF_SMALL}/documents.parquet'")
    expected = sorted((r[0], r[1], r[2], r[4]) for r in con.execute(exact_dedup.SQL).fetchall())
    assert got(exact_dedup.op10_exact_dedup(spark, SF_SMALL)) == sorted(expected, key=str)
