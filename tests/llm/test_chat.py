import random

import duckdb

from tidepool.llm import chat

from ..conftest import SF_SMALL
from .helpers import with_clashes

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def snapshots(seed):
    rnd, rows, conv = random.Random(seed), [], 0
    for _ in range(25):
        whole = [(rnd.choice(["user", "Assistant ", None]), rnd.choice(["hi", "no", None, "<|im_end|>", "a b"])) for _ in range(rnd.randint(1, 9))]
        for length in sorted(rnd.sample(range(1, len(whole) + 1), rnd.randint(1, len(whole)))) + [len(whole)] * rnd.randint(0, 3):
            rows += [(conv, t, *whole[t]) for t in range(length)]
            conv += 1
    return rows


AWKWARD = [(1000, 0, "user", "only"), (1000, 0, "user", "only"), (1001, None, "user", "first"), (1001, 5, "user", "second"), (1002, 3, "a", "tie"),
           (1002, 3, "b", "tie"), (None, 0, "user", "nobody"), (None, 1, None, None), (1003, 1, "", ""), (1004, -7, "user", "long " * 50_000)]


def got(df):
    return sorted(((r.conv_id, r.part, r.n_turns, r.n_copies, r.text) for r in df.collect()), key=str)


def by_sql(rows):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    names = [d[0] for d in con.execute(chat.SQL).description]
    at = [names.index(c) for c in ("conv_id", "part", "n_turns", "n_copies", "text")]
    return sorted((tuple(r[i] for i in at) for r in con.execute(chat.SQL).fetchall()), key=str)


def test_awkward_rows_match_sql(spark):
    rows = snapshots(3) + AWKWARD
    found = got(chat.format_chats(with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(3))))
    assert found == by_sql(rows)
    assert got(chat.format_chats(with_clashes(spark.createDataFrame(rows, SCHEMA)), range_turns=2)) == found


def test_only_maximal_conversations_stay(spark):
    rows = [(1, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "a", "b"), (3, 0, "u", "a"), (3, 1, "a", "b"), (4, 0, "u", "a"), (4, 1, "a", "c"), (5, 0, "a", "b")]
    found = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.conv_id, r.n_turns, r.n_copies) for r in found} == {(2, 2, 2), (4, 2, 1), (5, 1, 1)}


def test_long_conversations_come_in_parts(spark):
    rows = [(1, t, "u", str(t)) for t in range(25)]
    found = got(chat.format_chats(spark.createDataFrame(rows, SCHEMA), range_turns=4, part_turns=10))
    assert [(p, n) for _, p, n, _, _ in found] == [(0, 25), (1, 25), (2, 25)]
    assert "".join(r[4] for r in found) == "".join(f"<|im_start|>u\n{t}<|im_end|>\n" for t in range(25))


def test_empty_table_and_plan(spark):
    empty = chat.format_chats(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["conv_id", "part", "n_turns", "n_copies", "text"]
    plan = empty._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF_SMALL}/conversations.parquet'")
    names = [d[0] for d in con.execute(chat.SQL).description]
    at = [names.index(c) for c in ("conv_id", "part", "n_turns", "n_copies", "text")]
    expected = sorted((tuple(r[i] for i in at) for r in con.execute(chat.SQL).fetchall()), key=str)
    assert got(chat.op4_chat_formatting(spark, SF_SMALL)) == expected
