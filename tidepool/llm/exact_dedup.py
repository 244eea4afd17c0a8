"""Exact deduplication by Grace hashing.

1. **Combine.** Every task streams its documents through an open-addressing table that compares
   complete texts; a text that the task saw before becomes a member of the first one's record. The
   table is emptied whenever it holds ``table_bytes`` of text, so a text that a third of all rows
   share leaves a task as a few records, however many rows there are.
2. **Partition.** The records (one text each) are written to the shared folder and dealt to buckets
   by a hash of the text. Buckets above ``table_bytes`` are split again by the next, independent
   hash, recursively; a bucket whose rows all have one hash cannot be split and need not be: its
   table holds a single text.
   Before that, the copies of a text whose records together exceed ``table_bytes`` are folded in a
   tree: dealt by record number to groups of bounded size, each of which compares complete texts
   and passes on one record for each text, until what is left of a hash fits.
3. **Compare.** Each bucket is loaded into an open-addressing table (hash slots, linear probing,
   complete texts compared), which yields the row to keep and the size of each group.
4. The members, ids only, get their group by a join on the record's number.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import ddl, fresh_name, table, text_of, written
from tidepool.session import default_partitions, scratch_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEMBERS = pa.schema([("record", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("hash", pa.int64()),
                     ("n_bytes", pa.int64()), ("n_rows", pa.int64()), ("max_id", pa.int64()), ("top", pa.bool_())])
GROUPS = pa.schema([("record", pa.int64()), ("keep_id", pa.int64()), ("keep_record", pa.int64()),
                    ("group_size", pa.int64()), ("text_sha256", pa.string())])
FOLDED = pa.schema([("record", pa.int64()), ("root", pa.int64()), ("text", pa.string()), ("hash", pa.int64()), ("n_bytes", pa.int64()),
                    ("n_rows", pa.int64()), ("max_id", pa.int64())])
LOWEST = -(1 << 63)  # a null id, below every other
#: Hashes share a slot to be marked as hot, so that the marks are a table of this many rows at most.
HOT_SLOTS = 1 << 16
#: Copies of one hash that a folding group takes however long they are; a hash with no more is not folded.
FOLD = 8
#: Buckets are so many times finer than a table, as many small ones fill the tasks more evenly than a few large ones.
FINE = 16


class TextTable:
    """Open addressing with linear probing; equal hashes are settled by comparing whole texts."""

    def __init__(self, capacity: int = 1024):
        self.slots = np.full(capacity, -1, dtype=np.int64)
        self.texts: list = []
        self.hashes: list[int] = []

    def find_or_add(self, text, h: int) -> tuple[int, bool]:
        """The entry's number and whether it is new."""
        slots, mask = self.slots, len(self.slots) - 1
        at = h & mask
        while (entry := slots[at]) >= 0:
            if self.hashes[entry] == h and self.texts[entry] == text:
                return int(entry), False
            at = (at + 1) & mask
        slots[at] = len(self.texts)
        self.texts.append(text)
        self.hashes.append(h)
        if 2 * len(self.texts) > len(slots):
            self._grow()
        return len(self.texts) - 1, True

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, dtype=np.int64)
        mask = len(self.slots) - 1
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def _combine(table_bytes: int, table_rows: int, hash_of: Callable[[bytes], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = None
        entries, rows, held, best = TextTable(), [], 0, []

        def flush():
            # the first row with the largest id stands for its text: it carries the text itself
            cols = [[] for _ in MEMBERS]
            counts = np.bincount([e for e, _ in rows], minlength=len(entries.texts))
            for number, (entry, doc_id) in enumerate(rows):
                top = best[entry][1] == number
                text = entries.texts[entry] if top else None
                values = (base + entry, None if doc_id == LOWEST else doc_id, text, _signed(entries.hashes[entry]) if top else None,
                          len(text) if top else None, int(counts[entry]) if top else None,
                          None if best[entry][0] == LOWEST else best[entry][0], top)
                for c, v in zip(cols, values):
                    c.append(v)
            arrays = [pa.array([None if t is None else t.decode() for t in c] if f.name == "text" else c, f.type)
                      for f, c in zip(MEMBERS, cols)]
            return pa.record_batch(arrays, schema=MEMBERS)

        base = 0
        for batch in batches:
            for part, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if task is None:
                    task = part
                    base = task << 36
                raw = text.encode()
                entry, new = entries.find_or_add(raw, hash_of(raw))
                doc_id = LOWEST if doc_id is None else doc_id
                if new:
                    best.append((doc_id, len(rows)))
                    held += len(raw)
                elif doc_id > best[entry][0]:
                    best[entry] = (doc_id, len(rows))
                rows.append((entry, doc_id))
                if held >= table_bytes or len(rows) >= table_rows:
                    yield flush()
                    base += len(entries.texts)
                    entries, rows, held, best = TextTable(), [], 0, []
        if rows:
            yield flush()

    return run


def _compare(hash_of: Callable[[bytes], int]):
    """One bucket in, a row for each of its records out."""

    def run(group: pa.Table) -> pa.Table:
        entries, found, of = TextTable(), [], []
        records, texts, rows, tops = (group.column(c).to_pylist() for c in ("record", "text", "n_rows", "max_id"))
        for record, text, n, top in zip(records, texts, rows, tops):
            raw = text.encode()
            entry, new = entries.find_or_add(raw, hash_of(raw))
            top = LOWEST if top is None else top
            if new:
                found.append([top, record, 0])
            best = found[entry]
            best[2] += n
            # ties in the id (repeated rows): the smallest record number stays
            if top > best[0] or (top == best[0] and record < best[1]):
                best[0], best[1] = top, record
            of.append(entry)
        sha = [hashlib.sha256(t).hexdigest() for t in entries.texts]
        return pa.table([records, pa.array([None if found[e][0] == LOWEST else found[e][0] for e in of], pa.int64()),
                         [found[e][1] for e in of], [found[e][2] for e in of], [sha[e] for e in of]], schema=GROUPS)

    return run


def _fold(hash_of: Callable[[bytes], int]):
    """A group of records in, the root of each out; the root of a text carries it on, with the rows
    of all and the largest id. Ties in the id: the smallest record number."""

    def run(group: pa.Table) -> pa.Table:
        columns = {f.name: group.column(f.name).to_pylist() for f in FOLDED if f.name != "root"}
        entries, best, of = TextTable(), [], []
        order = [(LOWEST if m is None else m, -r) for m, r in zip(columns["max_id"], columns["record"])]
        for number, text in enumerate(columns["text"]):
            raw = text.encode()
            entry, new = entries.find_or_add(raw, hash_of(raw))
            if new:
                best.append(number)
            elif order[number] > order[best[entry]]:
                best[entry] = number
            of.append(entry)
        counts = [0] * len(best)
        for entry, n in zip(of, columns["n_rows"]):
            counts[entry] += n
        stays = [best[entry] == number for number, entry in enumerate(of)]
        columns["root"] = [columns["record"][best[entry]] for entry in of]
        columns["n_rows"] = [counts[entry] for entry in of]
        for name in ("text", "hash", "n_bytes", "n_rows", "max_id"):
            columns[name] = [v if stay else None for v, stay in zip(columns[name], stays)]
        return pa.table([pa.array(columns[f.name], f.type) for f in FOLDED], schema=FOLDED)

    return run


def _fold_hot(records: DataFrame, folder: str, table_bytes: int, hash_of: Callable[[bytes], int]) -> tuple[DataFrame, DataFrame | None]:
    """Records with at most ``table_bytes``, or :data:`FOLD` copies, of each hash, and which record
    stands for each of the others, (record, root); None where nothing was folded.

    Every round leaves at most an eighth of a hot text's copies. Hot slots reach the tasks as a
    broadcast table of at most :data:`HOT_SLOTS` rows; a cold hash that shares one is dealt like it,
    to no harm. Different texts of one hash stay apart, and end the rounds when folding stalls.
    """
    slot, links, before = F.pmod("hash", F.lit(HOT_SLOTS)), None, None
    for level in range(64):
        hashes = records.groupBy("hash").agg(F.sum("n_bytes").alias("held"), F.count("*").alias("n"))
        hot = (hashes.filter((F.col("held") > table_bytes) & (F.col("n") > FOLD))
               .select(slot.alias("slot"), "n", F.greatest(F.lit(1), F.least(F.ceil(2 * F.col("held") / table_bytes), F.floor(F.col("n") / FOLD))).alias("ways"))
               .groupBy("slot").agg(F.max("ways").cast("bigint").alias("ways"), F.sum("n").alias("n")))
        hot = written(hot.coalesce(1), folder, f"hot{level}")
        left = hot.agg(F.sum("n")).first()[0]
        if left is None or left == before:
            break
        before = left
        marked = records.withColumn("slot", slot).join(F.broadcast(hot.drop("n")), "slot", "left")
        salt = F.pmod(F.xxhash64("record", F.lit(level)), F.col("ways"))
        folded = written(marked.filter("ways is not null").withColumn("salt", salt).groupBy("slot", "salt").applyInArrow(_fold(hash_of), ddl(FOLDED)),
                         folder, f"folded{level}")
        now = folded.select("record", "root")
        if links is None:
            links = now
        else:  # the roots of earlier rounds have roots of their own now
            links = (links.withColumnRenamed("root", "via").join(now.withColumnRenamed("record", "via"), "via", "left")
                     .select("record", F.coalesce("root", "via").alias("root"))
                     .unionByName(now.join(links.select("record"), "record", "left_anti")))
        records = (marked.filter("ways is null").select(*records.columns)
                   .unionByName(folded.filter("text is not null").select(*records.columns)))
    return records, links


def content_hash(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw)


def _split_buckets(records: DataFrame, table_bytes: int, max_depth: int) -> tuple[DataFrame, int]:
    """Give each record a ``bucket`` such that no bucket that can be split exceeds ``table_bytes``.

    Only counters reach the driver, never rows. Returns the records and the number of buckets of
    the first level.
    """
    total = records.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    fan_out = max(2, -(-2 * FINE * int(total) // table_bytes))
    frame = records.withColumn("bucket", F.pmod(F.xxhash64(F.lit(0), "hash"), F.lit(fan_out)))
    for depth in range(1, max_depth + 1):
        sizes = frame.groupBy("bucket").agg(F.sum("n_bytes").alias("held"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        large = sizes.filter((F.col("held") > table_bytes) & (F.col("lo") != F.col("hi"))).select("bucket", "held")
        if large.isEmpty():
            break
        # the next level's hash is independent of the last one's, so it tells the rows apart again
        large = large.withColumn("ways", F.greatest(F.lit(2), F.ceil(2 * F.col("held") / table_bytes).cast("bigint")))
        frame = (frame.join(large.drop("held"), "bucket", "left")
                 .withColumn("bucket", F.when(F.col("ways").isNull(), F.col("bucket")).otherwise(
                     F.xxhash64("bucket", F.lit(depth), F.pmod(F.xxhash64(F.lit(depth), "hash"), F.col("ways")))))
                 .drop("ways"))
    return frame, fan_out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = 16 << 20,
                 table_rows: int = 200_000, max_depth: int = 8,
                 hash_of: Callable[[bytes], int] = content_hash) -> DataFrame:
    """Groups of equal texts: one row per input row.

    Columns: ``doc_id``, ``keep_id`` (largest id of the group), ``group_size``, ``kept`` and
    ``text_sha256``. Exactly one row of each group is kept: the one with the largest id; of rows
    repeated with that id, one. A null text is the empty text. A null id sorts below all others (a
    group of null ids has a null ``keep_id``). An empty table gives no rows; other columns are not
    read. ``hash_of`` may collide: equality is always that of the complete texts.
    """
    spark = docs.sparkSession
    folder = scratch_folder(spark)
    rows = docs.select(F.spark_partition_id().cast("bigint").alias("part"), F.col(id_col).cast("bigint").alias("doc_id"),
                       text_of(text_col).alias("text"))
    members = written(rows.mapInArrow(_combine(table_bytes, table_rows, hash_of), ddl(MEMBERS)), folder, "members")
    records = members.filter("top").select("record", "text", "n_rows", "max_id", "hash", "n_bytes")
    records, links = _fold_hot(records, folder, table_bytes, hash_of)
    dealt, fan_out = _split_buckets(records, table_bytes, max_depth)
    groups = (dealt.select("bucket", "record", "text", "n_rows", "max_id")
              .repartition(max(default_partitions(spark), fan_out // (2 * FINE)), "bucket")
              .groupBy("bucket").applyInArrow(_compare(hash_of), ddl(GROUPS)))
    rows = members.select("record", "doc_id", "top")
    if links is None:
        rows = rows.withColumn("root", F.col("record"))
    else:
        rows = rows.join(links, "record", "left").withColumn("root", F.coalesce("root", "record"))
    return (rows.join(groups.withColumnRenamed("record", "root"), "root")
            .select("doc_id", "keep_id", "group_size",
                    (F.col("top") & (F.col("record") == F.col("keep_record"))).alias("kept"), "text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`exact_groups` keeps."""
    by_id, by_text = fresh_name(docs, "by_id"), fresh_name(docs, "by_text")
    kept = exact_groups(docs, id_col, text_col).filter("kept")
    keys = kept.select(F.coalesce("doc_id", F.lit(LOWEST)).alias(by_id), F.col("text_sha256").alias(by_text))
    marked = docs.withColumns({by_id: F.coalesce(F.col(id_col).cast("bigint"), F.lit(LOWEST)), by_text: F.sha2(text_of(text_col).cast("binary"), 256)})
    # the id and digest also tell rows apart that repeat an id with another text; repeated rows go
    return marked.join(keys, [by_id, by_text], "left_semi").dropDuplicates([by_id, by_text]).drop(by_id, by_text)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts; the largest doc_id stays."""
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))"""
