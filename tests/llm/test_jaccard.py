import random
import re
from itertools import combinations

import duckdb
import numpy as np
import pytest

from tidepool.llm import jaccard

from ..conftest import SF_SMALL
from .helpers import AWKWARD, documents


def brute_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k=5, percent=80):
    sets = [brute_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None and sets[x]:
            least[root(x)] = min(i, least.get(root(x), i))
    return sorted(((i, len(s), least.get(root(x)) if s else i) for x, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_awkward_rows(spark):
    rows = AWKWARD + [(20, "one two"), (21, "ONE  two"), (22, "one two three four five"), (23, "one two three four five six")]
    assert got(jaccard.jaccard_components(documents(spark, rows))) == brute(rows)


def test_empty_table_and_texts_without_words(spark):
    assert got(jaccard.jaccard_components(documents(spark, AWKWARD).limit(0))) == []
    rows = [(1, None), (2, ""), (2, "\t \n"), (None, " ")]
    assert got(jaccard.jaccard_components(documents(spark, rows))) == brute(rows)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF_SMALL}/documents.parquet'")
    found = con.sql(jaccard.SQL)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert got(jaccard.op11_jaccard_join(spark, SF_SMALL)) == sorted(found.fetchall(), key=str)


def families(seed, n_families, members, shared=""):
    """Near copies of random texts, so that similarities lie on both sides of the bound; all texts hold ``shared``."""
    rnd, rows = random.Random(seed), []
    for _ in range(n_families):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.randint(4, 70))]
        for _ in range(members):
            text = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 20))):
                text[rnd.randrange(len(text))] = f"x{rnd.randrange(1000)}"
            rows.append((len(rows) * 7 % 1009, " ".join(text) + shared))
    return rows


@pytest.mark.parametrize("percent,k,pairs_per_posting", [(80, 5, 0), (50, 2, 0.5), (100, 1, 8)])
def test_no_link_is_lost(spark, percent, k, pairs_per_posting):
    rows = families(percent + k, 8, 14) + [(2000 + i, "the same few words in every one " + " ".join(f"y{i}{j}" for j in range(9))) for i in range(20)]
    assert got(jaccard.jaccard_components(documents(spark, rows), k, percent, pairs_per_posting=pairs_per_posting)) == brute(rows, k, percent)


def test_a_passage_that_all_documents_share(spark):
    rows = families(5, 6, 10, " " + " ".join(f"common{i}" for i in range(60)))
    assert got(jaccard.jaccard_components(documents(spark, rows))) == brute(rows)


def test_pivots_collapse_a_large_group(spark, monkeypatch):
    """Of 300 near copies the pairs counted are a small part of all 44,850."""
    counted, verify = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *a: counted.append(pairs.count()) or verify(pairs, *a))
    rnd = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        text = list(base)
        text[rnd.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(text)))
    assert got(jaccard.jaccard_components(documents(spark, rows))) == brute(rows)
    assert sum(counted) < 6000


def test_lists_and_groups_divided_into_parts(spark, monkeypatch):
    whole = jaccard._all_pairs
    monkeypatch.setattr(jaccard, "_all_pairs", lambda small, large, percent: whole(small, large, percent, list_rows=5, group_rows=40))
    rows = families(9, 6, 12)
    assert got(jaccard.jaccard_components(documents(spark, rows), pairs_per_posting=1e9)) == brute(rows)


def test_prefix_lengths_follow_the_cost():
    rare, common = np.full(100, 2.0), np.full(100, 500.0)
    assert jaccard.choose_length(100, 21, rare, 80) == (1, 0)  # the shortest prefix occurs nowhere else
    short, long = jaccard.choose_length(100, 0, rare, 80), jaccard.choose_length(100, 0, np.r_[np.full(60, 2.0), common[:40]], 80)
    assert short[0] >= 1 and short[1] == 20 + short[0]
    # cheap postings lengthen the prefix, up to where dear ones begin
    assert 20 + long[0] <= 60 and long[0] > 1


def test_packing_round_trip():
    rnd = np.random.default_rng(3)
    for values in ([], [0], [5, 5, 5], rnd.integers(0, 1 << 62, 1000), rnd.integers(0, 300, 1000)):
        x = np.sort(np.array(values, dtype=np.uint64))
        assert (jaccard.unpack(jaccard.pack(x)) == x).all()


def test_words_of_all_pieces(monkeypatch):
    texts = [t.encode() for t in ("", "a", "One two", " \tTwo  one\x0b\x0c", "x" * 300 + " y " * 50, "é b  c", "one two")]
    whole = [s.tolist() for s in jaccard.shingle_sets(texts, 2)]
    monkeypatch.setattr(jaccard, "CHUNK_BYTES", 7)
    assert [s.tolist() for s in jaccard.shingle_sets(texts, 2)] == whole
    assert [len(s) for s in whole] == [len(brute_set(t.decode(), 2)) for t in texts] and whole[2] == whole[6] != whole[3]
