"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

Loggers write a conversation again after each turn, so that most logged conversations are prefixes of
longer ones. A turn's hash covers its position, role and text; the running sums of two such hashes
identify every turn prefix. Prefixes that are shorter than their conversation form one set, each key
once; conversations whose whole hash is in it are dropped by an anti-join, equal ones are one. Only
what is left is rendered.

No conversation is handled by one task: positions and running sums are taken inside (conversation,
turn range) and carried over by the ranges' totals, and a rendered conversation is a row per
``part_turns`` turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.llm.common import table, text_of, written
from tidepool.session import scratch_folder

RANGE_TURNS, PART_TURNS = 1024, 256
HASH = "decimal(38,0)"


def numbered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text", range_turns: int = RANGE_TURNS) -> DataFrame:
    """(conv_id, pos, role, text, h1, h2): turns in order of (turn, role, text), numbered from 1, with
    the hashes of the prefix that each one ends. Repeated rows count once."""
    rows = turns.select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
                        text_of(role_col).alias("role"), text_of(text_col).alias("text")).distinct()
    rows = rows.withColumn("range", F.floor(F.coalesce("turn", F.lit(0)) / range_turns))
    # a null turn comes before all others
    rows = rows.withColumn("range", F.when(F.col("turn").isNull(), F.lit(-(1 << 62))).otherwise(F.col("range")))
    order = [F.asc_nulls_first("turn"), "role", "text"]
    inside = Window.partitionBy("conv_id", "range").orderBy(*order)
    rows = rows.withColumn("at", F.row_number().over(inside).cast("bigint"))
    sizes = rows.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r"))
    placed = rows.join(starts, same).select("conv_id", "range", (F.col("start") + F.col("at")).alias("pos"), "role", "text")
    for seed, name in enumerate(("t1", "t2")):
        placed = placed.withColumn(name, F.xxhash64(F.lit(seed), "pos", "role", "text").cast(HASH))
    sums = placed.groupBy("conv_id", "range").agg(*(F.sum(t).cast(HASH).alias(t) for t in ("t1", "t2")))
    carried = sums.select(F.col("conv_id").alias("c"), F.col("range").alias("r"),
                          *(F.coalesce(F.sum(t).over(before), F.lit(0)).cast(HASH).alias(f"{t}_before") for t in ("t1", "t2")))
    running = Window.partitionBy("conv_id", "range").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return (placed.join(carried, same)
            .select("conv_id", "pos", "role", "text", *((F.sum(t).over(running) + F.col(f"{t}_before")).cast(HASH).alias(h)
                                                       for t, h in (("t1", "h1"), ("t2", "h2")))))


def maximal_conversations(numbered: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): conversations that are no strict prefix of another; of equal
    ones the smallest id, with their number."""
    lengths = numbered.groupBy("conv_id").agg(F.max("pos").alias("n_turns"))
    marked = (numbered.select("conv_id", "pos", "h1", "h2")
              .join(lengths.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c"))
    inner = marked.filter("pos < n_turns").select("pos", "h1", "h2").distinct()
    whole = marked.filter("pos = n_turns").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    return whole.join(inner, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "n_copies")


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn in the chat format. ``<|`` inside a text is broken up, so that no turn can forge a marker."""
    name = F.lower(F.trim(role))
    return F.concat(F.lit("<|im_start|>"), F.when(name == "", "unknown").otherwise(name), F.lit("\n"), F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("<|im_end|>\n"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 range_turns: int = RANGE_TURNS, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, n_turns, n_copies, text): the maximal conversations in the chat format.

    A conversation of up to ``part_turns`` turns is one row (part 0); the concatenated parts are the
    rendered conversation. Turns are ordered by (turn, role, text), a null turn first; repeated rows
    count once; a null text is empty, a null or empty role is rendered as ``unknown``. Rows with a
    null id are a conversation of their own. An empty table gives no rows.
    """
    numbered = written(numbered_turns(turns, conv_col, turn_col, role_col, text_col, range_turns), scratch_folder(turns.sparkSession), "turns")
    kept = maximal_conversations(numbered).withColumnRenamed("conv_id", "c")
    part = F.floor((F.col("pos") - 1) / part_turns).alias("part")
    rows = (numbered.select("conv_id", "pos", "role", "text").join(kept, F.col("conv_id").eqNullSafe(F.col("c")))
            .select("conv_id", part, "n_turns", "n_copies", F.struct("pos", rendered_turn(F.col("role"), F.col("text")).alias("turn")).alias("turn")))
    return (rows.groupBy("conv_id", "part", "n_turns", "n_copies").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
            .select("conv_id", "part", "n_turns", "n_copies", F.array_join("turns.turn", "").alias("text")))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal conversation, rendered."""
    return format_chats(table(spark, sf_dir, "conversations"))


SQL = f"""
with t as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
p as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from t),
c as (select conv_id, count(*) as n, list(struct_pack(role, text) order by pos) as turns from p group by conv_id),
w as (select turns, n, min(conv_id) as conv_id, count(*) as n_copies from c group by turns, n),
m as (select * from w where not exists (select 1 from c where c.n > w.n and c.turns[1:w.n] = w.turns))
select m.conv_id, (pos - 1) // {PART_TURNS} as part, m.n as n_turns, m.n_copies,
       string_agg('<|im_start|>' || case when lower(trim(role)) = '' then 'unknown' else lower(trim(role)) end || chr(10)
                  || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' order by pos) as text
from m join p on p.conv_id is not distinct from m.conv_id
group by all"""
