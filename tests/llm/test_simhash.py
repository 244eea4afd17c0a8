import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tidepool.llm import components, simhash

from ..conftest import SF_SMALL
from .helpers import AWKWARD, documents


def brute_fingerprint(text, k=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(parent), 2):
        if bin(a ^ b).count("1") <= radius:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {f: root(f) for f in parent}


def brute_groups(rows, radius=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    root, least = brute_components(set(fps), radius), {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    return sorted(((i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, fps)), key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_awkward_rows(spark):
    rows = AWKWARD + [(20, "one two"), (21, "ONE  two"), (22, "one two three four five")]
    assert got(simhash.near_groups(documents(spark, rows))) == brute_groups(rows)


def test_empty_table(spark):
    assert simhash.near_groups(documents(spark, AWKWARD).limit(0)).collect() == []


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert got(simhash.op6_simhash_near_dedup(spark, SF_SMALL)) == brute_groups(rows)


def clustered(n, seed):
    rnd, out = random.Random(seed), set()
    centres = [rnd.getrandbits(64) for _ in range(5)]
    while len(out) < n:
        f = rnd.choice(centres)
        for _ in range(rnd.randint(0, 9)):
            f ^= 1 << rnd.randrange(64)
        out.add(f)
    return out | {rnd.getrandbits(64) & ~0xFFFF for _ in range(n // 4)}


@pytest.mark.parametrize("radius,bucket_rows", [(0, 20_000), (2, 10), (4, 20_000), (4, 5), (6, 50)])
def test_no_link_is_lost(spark, radius, bucket_rows):
    fps = clustered(400, radius)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp bigint")
    links = simhash.near_links(df, radius, bucket_rows)
    root = {r.node: r.root for r in components.components(links).collect()}
    named = {}
    for f, r in brute_components(fps, radius).items():
        named.setdefault(r, set()).add(simhash._signed(f))
    for members in named.values():
        assert len({root.get(m, m) for m in members}) == 1
    assert len(named) == len({root.get(simhash._signed(f), simhash._signed(f)) for f in fps})


@pytest.mark.parametrize("radius", [0, 1, 4, 7])
def test_thresholds_cover_the_radius_and_follow_the_counts(radius):
    _, t = simhash.allot([16, 16, 16, 16], [1e9, 1e3, 1e3, 1e3], 10_000, radius)
    assert sum(x + 1 for x in t) == radius + 1 and min(t) >= -1
    assert t[0] <= min(t[1:])  # the fullest partition is probed least


def test_correlated_bits_are_grouped():
    corr = np.eye(64)
    for a in (3, 17, 40, 63):
        for b in (3, 17, 40, 63):
            corr[a, b] = 1
    parts = simhash.group_bits(corr, 4)
    assert sorted(b for p in parts for b in p) == list(range(64))
    assert any({3, 17, 40, 63} <= set(p) for p in parts)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 30)] + [(7, 7), (50, 51), (51, 50)]
    root = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {root[i] for i in range(100, 141)} == {100} and {root[i] for i in range(30)} == {0} and root[51] == root[50] == 50
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_representatives(spark):
    docs = documents(spark, AWKWARD)
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    named = {c for _, _, c in brute_groups(AWKWARD)}
    assert {r.doc_id for r in kept.collect()} == named
