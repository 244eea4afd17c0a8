"""Trie of conversation prefixes by van Emde Boas recursion.

The trie's depths are cut in halves, those again, down to single turns; all cells of one height are
handled together, so that the number of steps grows with the logarithm of the longest conversation and
no task holds a conversation or a subtree.

1. **Names.** Runs of 2, 4, 8, ... turns get a name (128 bits) from the names of their halves. From the
   whole down, a cell is cut at half depth: the prefix that ends at the cut is named by the prefix above
   the cell and the run between. Upper tries and lower forests then go on in the same way. Equal
   prefixes have equal names, so every name is a node.
2. **Totals.** Cells of one depth hold each node's own numbers. Going back up, the totals of a cell's
   lower forests, summed by the nodes above the cut, are grafted onto all their ancestors in the upper
   trie: these are the rows of one member conversation, no more than the input has.
3. **Ends.** The ids of conversations that end at a node are joined into pieces by ranges of ids; the
   pieces pass in order through one running digest a node.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.llm.common import table, text_of, written
from tidepool.session import scratch_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_TURNS, PIECE_IDS = 1024, 4096
DONOR_EVERY, MOST_BORROWED = 20, 4
WORD = "[^\\x20\\x09-\\x0D]+"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def numbered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                   range_turns: int = RANGE_TURNS) -> DataFrame:
    """(conv_id, pos, role, text): turns in order of (turn, role, text), a null turn first, numbered from
    1. Positions are taken inside ranges of turn numbers and moved up by the ranges before. Null roles
    and texts are empty; repeated rows are turns of their own; rows with a null id are left out."""
    rows = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
                                                            text_of(role_col).alias("role"), text_of(text_col).alias("text"))
    rows = rows.withColumn("range", F.coalesce(F.floor(F.col("turn") / range_turns), F.lit(-(1 << 62))))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("conv_id", "range").orderBy("turn", "role", "text")).cast("bigint"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
              .select("conv_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint")).alias("start")))
    return rows.join(starts, ["conv_id", "range"]).select("conv_id", (F.col("start") + F.col("at")).alias("pos"), "role", "text")


def _name(*parts: Column) -> list[Column]:
    """Two independent 64-bit hashes as the columns a and b."""
    return [F.xxhash64(F.lit(seed), *parts).alias(c) for seed, c in ((1, "a"), (2, "b"))]


def prefix_names(sequences: DataFrame, convs: DataFrame, folder: str) -> tuple[list[DataFrame], int]:
    """([(conv_id, d, a, b)], number of levels): the names of all prefixes of d turns, d from 0."""
    runs = [written(sequences.select("conv_id", (F.col("pos") - 1).alias("j"), *_name(F.col("role"), F.col("text"))), folder, "runs-0")]
    deepest = sequences.agg(F.max("pos")).first()[0] or 0
    levels = int(deepest).bit_length()  # 2 ** levels > deepest
    for k in range(1, levels):
        half = F.struct("j", "a", "b")
        pairs = (runs[-1].groupBy("conv_id", F.shiftright("j", 1).alias("i")).agg(F.min(half).alias("x"), F.max(half).alias("y"), F.count("*").alias("n")).filter("n = 2"))
        runs.append(written(pairs.select("conv_id", F.col("i").alias("j"), *_name(F.col("x.a"), F.col("x.b"), F.col("y.a"), F.col("y.b"))), folder, f"runs-{k}"))
    zero = F.lit(0).cast("bigint")
    parts = [convs.select("conv_id", zero.alias("d"), zero.alias("a"), zero.alias("b"))]
    for k in range(levels, 0, -1):  # cells of 2 ** k depths, cut at half
        height = 1 << (k - 1)
        run = runs[k - 1].select(F.col("conv_id").alias("c"), "j", F.col("a").alias("ra"), F.col("b").alias("rb"))
        for n, part in enumerate(list(parts)):
            tops = part if n == 0 else tops.unionByName(part)
        cut = (tops.join(run, (F.col("conv_id") == F.col("c")) & (F.col("j") == F.floor(F.col("d") / height)))
               .select("conv_id", (F.col("d") + height).alias("d"), *_name(F.col("a"), F.col("b"), F.col("ra"), F.col("rb"))))
        parts.append(written(cut, folder, f"prefixes-{k}"))
    return parts, levels


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each node's pieces, which come in order."""
    def row(key, digest):
        return pa.record_batch([pa.array([v]) for v in (*key, digest.hexdigest())], names=["conv_id", "depth", "ends_sha256"])

    last, digest = None, None
    for batch in batches:
        done = []
        for conv, depth, piece in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids"))):
            if (conv, depth) != last:
                if last:
                    done.append(row(last, digest))
                last, digest = (conv, depth), hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
        yield from done
    if last:
        yield row(last, digest)


def ends_digests(ends: DataFrame, piece_ids: int = PIECE_IDS) -> DataFrame:
    """(conv_id, depth, ends_sha256) from (conv_id, depth, member): members in order, comma-joined. A
    node's ids pass through one running digest, as pieces of at most ``piece_ids`` different ids."""
    pieces = (ends.groupBy("conv_id", "depth", F.floor(F.col("member") / piece_ids).alias("piece"))
              .agg(F.array_join(F.sort_array(F.collect_list("member")).cast("array<string>"), ",").alias("ids")))
    ordered = pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "piece")
    return ordered.select("conv_id", "depth", "ids").mapInArrow(_ends, "conv_id bigint, depth bigint, ends_sha256 string")


def prefix_trie(sequences: DataFrame, convs: DataFrame, piece_ids: int = PIECE_IDS) -> DataFrame:
    """The trie's nodes: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``sequences``: (conv_id, pos, role, text), positions from 1 without gaps; ``convs``: (conv_id), each
    once, also those without turns. A node is a distinct sequence of the first ``depth`` turns, known by
    its smallest member; the root has depth 0 and is there if any conversation is. ``saved_tokens`` sums
    (members - 1) times the words of the last text over the subtree. No conversations, no rows.
    """
    folder = scratch_folder(sequences.sparkSession)
    words = written(sequences.select("conv_id", F.col("pos").alias("d"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words")), folder, "words")
    parts, levels = prefix_names(sequences, convs, folder)
    for n, part in enumerate(parts):
        named = part if n == 0 else named.unionByName(part)
    tops = (named.groupBy("d", "a", "b").agg(F.min("conv_id").alias("top"), F.count("*").alias("n_convs")))
    tops = written(tops, folder, "tops")
    # each conversation's path: the node (top, d) that it passes at every depth
    path = written(named.join(tops, ["d", "a", "b"]).select("conv_id", "d", "top"), folder, "path")
    above = path.select(F.col("conv_id").alias("top"), (F.col("d") + 1).alias("d"), F.col("top").alias("parent"))
    nodes = tops.select("top", "d", "n_convs").join(above, ["top", "d"], "left").join(words.withColumnRenamed("conv_id", "top"), ["top", "d"], "left")
    nodes = written(nodes.select("top", "d", "parent", "n_convs", ((F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))).alias("saved")), folder, "nodes")
    children = nodes.filter("d > 0").groupBy(F.col("parent").alias("top"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"))
    sums = nodes.join(children, ["top", "d"], "left").select("top", "d", "parent", "n_convs", F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"),
                                                            F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint").alias("leaves"), "saved")
    sums = written(sums, folder, "totals-0")
    for k in range(1, levels + 1):  # cells of 2 ** k depths: graft what is below the cut
        cut = 1 << (k - 1)
        roots = sums.filter(F.col("d") % (2 * cut) == cut)
        cell = F.shiftright("d", k)
        below = roots.groupBy(F.col("parent").alias("conv_id"), cell.alias("cell")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        upper = path.filter(F.col("d") % (2 * cut) < cut).withColumn("cell", cell)
        grafts = upper.join(below, ["conv_id", "cell"]).groupBy("top", "d").agg(F.sum("l").alias("l"), F.sum("s").alias("s"))
        sums = (sums.join(grafts, ["top", "d"], "left")
                .select("top", "d", "parent", "n_convs", "n_children", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
                        (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")))
        sums = written(sums, folder, f"totals-{k}")
    lengths = path.groupBy("conv_id").agg(F.max("d").alias("d"))
    ends = path.join(lengths, ["conv_id", "d"]).select(F.col("top").alias("conv_id"), F.col("d").alias("depth"), F.col("conv_id").alias("member"))
    digests = ends_digests(ends, piece_ids)
    return (sums.select(F.col("top").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
                        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
            .join(digests, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA))))


def branched(numbered: DataFrame, every: int = DONOR_EVERY, most: int = MOST_BORROWED) -> tuple[DataFrame, DataFrame]:
    """(sequences, convs) of conversations that branch off others: each begins with the first h turns of
    the conversation whose id is the last one divisible by ``every``, h = crc32(id) % ``most``, and goes
    on with its own turns after its first h. One that is shorter, or absent, gives what it has."""
    convs = numbered.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    donors = convs.select(F.col("conv_id").alias("donor"), F.col("n").alias("has"))
    convs = (convs.withColumn("donor", F.col("conv_id") - F.col("conv_id") % every).join(donors, "donor", "left")
             .select("conv_id", "donor", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("borrowed")))
    firsts = numbered.filter(F.col("pos") < most).withColumnRenamed("conv_id", "donor")
    begin = convs.join(firsts, "donor").filter("pos <= h").select("conv_id", "pos", "role", "text")
    rest = numbered.join(convs, "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("borrowed")).alias("pos"), "role", "text")
    return begin.unionByName(rest), convs.select("conv_id")


def conversation_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                      branch: bool = False, range_turns: int = RANGE_TURNS, piece_ids: int = PIECE_IDS) -> DataFrame:
    """The prefix trie of a table of turns, one row per node (see :func:`prefix_trie`).

    Turns are ordered as in :func:`numbered_turns`: a null turn first, null roles and texts empty, repeated
    rows turns of their own, rows with a null id left out; other columns are not read. ``branch``: the
    conversations are first rebuilt by :func:`branched`. An empty table gives no rows.
    """
    folder = scratch_folder(turns.sparkSession)
    numbered = written(numbered_turns(turns, conv_col, turn_col, role_col, text_col, range_turns), folder, "turns")
    sequences, convs = branched(numbered) if branch else (numbered, numbered.select("conv_id").distinct())
    return prefix_trie(written(sequences, folder, "sequences"), written(convs, folder, "convs"), piece_ids)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    return conversation_trie(table(spark, sf_dir, "conversations"), branch=True)


SQL = f"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null),
c as (
  select conv_id, list(struct_pack(role, text) order by pos) as turns,
         xor(list_reduce([4294967295] || list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint),
                         lambda crc, x: list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0],
                                                    lambda r, z: xor(r // 2, 3988292384 * (r % 2)))), 4294967295) % {MOST_BORROWED} as h
  from t group by conv_id),
r as (
  select c.conv_id, case when d.conv_id is null then c.turns[c.h + 1:] else list_concat(d.turns[1:c.h], c.turns[c.h + 1:]) end as turns
  from c left join c d on d.conv_id = c.conv_id - c.conv_id % {DONOR_EVERY}),
p as (select conv_id, len(turns) as n, d, turns[1:d] as key from (select *, unnest(range(0, len(turns) + 1)) as d from r)),
n as (
  select key, d, min(conv_id) as conv_id, count(*) as n_convs,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = d), '')) as ends_sha256,
         case when d = 0 then 0 else (count(*) - 1) * len(regexp_extract_all(key[d].text, '[^\\x20\\x09-\\x0D]+')) end as saved
  from p group by key, d),
k as (select up.key, up.d, count(*) as n_children from n join n up on up.d = n.d - 1 and up.key = n.key[1:n.d - 1] group by up.key, up.d),
s as (
  select up.key, up.d, sum(n.saved)::bigint as saved_tokens, count(*) filter (where k.d is null) as n_leaves
  from n join n up on up.d <= n.d and up.key = n.key[1:up.d] left join k on k.key = n.key and k.d = n.d
  group by up.key, up.d)
select n.conv_id, n.d as depth, up.conv_id as parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children, s.n_leaves, s.saved_tokens,
       n.ends_sha256
from n join s on s.key = n.key and s.d = n.d left join k on k.key = n.key and k.d = n.d
  left join n up on up.d = n.d - 1 and up.key = n.key[1:n.d - 1]"""
