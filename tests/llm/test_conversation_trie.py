import hashlib
import random
import re
import zlib

import duckdb
import pytest

from tidepool.llm import conversation_trie

from ..conftest import SF_SMALL
from .helpers import with_clashes


def turns_table(spark, rows):
    return with_clashes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3))


def brute(rows, branch):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    whole = own
    if branch:
        whole = {}
        for c, v in own.items():
            h, donor = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
            whole[c] = own.get(donor, [])[:h] + v[h:]
    members = {}
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    children, saved, leaves = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for key in members:
        if key:
            children[key[:-1]] = children.get(key[:-1], 0) + 1
    for key, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        for d in range(len(key) + 1):
            saved[key[:d]] += (len(m) - 1) * words
            leaves[key[:d]] += key not in children
    return sorted(((min(m), len(key), min(members[key[:-1]]) if key else None, len(m), children.get(key, 0), leaves[key], saved[key],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(key)).encode()).hexdigest())
                   for key, m in members.items()), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


AWKWARD = [(0, 0, "user", "one two"), (0, 1, None, None), (0, 2, "user", ""), (0, 2, "user", ""), (1, None, "user", "one two"), (1, 5, "", ""), (1, 3, "a", "b"),
           (2, 0, "user", "one two"), (2, 0, "user", "one two"), (2, 1, "", None), (3, None, None, None), (3, None, None, None), (None, 0, "user", "lost"),
           (20, 0, "user", "long " * 3000), (21, 0, "user", "long " * 3000), (21, 0, "us", "er"), (22, 0, "u", "ser"), (-3, 0, "user", "below"), (-20, 0, "x", "y z"),
           (45, 0, "user", "one two"), (45, -2_000, "user", "early"), (45, 1 << 40, "user", "late")]


@pytest.mark.parametrize("branch", [False, True])
def test_awkward_rows(spark, branch):
    df = conversation_trie.conversation_trie(turns_table(spark, AWKWARD), branch=branch, piece_ids=2)
    assert got(df) == brute(AWKWARD, branch)


def test_empty_table(spark):
    assert conversation_trie.conversation_trie(turns_table(spark, AWKWARD).limit(0), branch=True).collect() == []


def snapshots(seed):
    """Conversations that grow out of each other, one of 150 turns, and many copies of a short one."""
    rnd, rows = random.Random(seed), []
    bases = [[("user" if i % 2 else "bot", f"say {rnd.randrange(3)} " * rnd.randrange(3)) for i in range(n)] for n in (150, 70, 9, 8, 3)]
    for c in range(60):
        turns = rnd.choice(bases)[:rnd.randrange(1, 160)]
        if rnd.random() < .4:
            turns = [*turns[:rnd.randrange(len(turns) + 1)], ("user", f"new {rnd.randrange(2)}")]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    return rows + [(c, i, "user", "the same") for c in range(1000, 1080) for i in range(2)]


@pytest.mark.parametrize("branch,range_turns,piece_ids", [(False, 16, 7), (True, 1024, 4096)])
def test_against_brute_force(spark, branch, range_turns, piece_ids):
    rows = snapshots(range_turns)
    df = conversation_trie.conversation_trie(turns_table(spark, rows), branch=branch, range_turns=range_turns, piece_ids=piece_ids)
    assert got(df) == brute(rows, branch)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF_SMALL}/conversations.parquet'")
    found, df = con.sql(conversation_trie.SQL), conversation_trie.op12_conversation_trie(spark, SF_SMALL)
    assert found.columns == df.columns
    assert got(df) == sorted(found.fetchall(), key=str)
