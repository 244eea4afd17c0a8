"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are divided into partitions. If the thresholds t_i satisfy sum(t_i + 1) = radius + 1,
then two fingerprints within the radius differ in at most t_i bits in some partition i, so it is
enough to probe each partition for all values within its own threshold (t_i = -1: not at all) and
verify. Bits that go together are put into one partition, so that the others stay selective, and a
dynamic programme allots the thresholds from the number of candidates that each would give,
counted over all fingerprints.

Equal fingerprints are one row before anything is compared. Inside a bucket a spanning forest of the
links is emitted, not its pairs; buckets above ``bucket_rows`` are divided by a second pigeonhole
over the remaining bits.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import ddl, packed, table, text_of, written
from tidepool.llm.components import components
from tidepool.session import default_partitions, scratch_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS, SHINGLE_WORDS, RADIUS, SEED = 64, 4, 4, 42
BUCKET_ROWS = 20_000
PARTITIONINGS = (2, 3, 4, 5)
ROW_COST = 400.0  # comparisons that cost as much as shuffling one row
SMALL_GROUP = 64
FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def shingle_hashes(text: str, k: int) -> list[int]:
    """XXH64 of the shingles, repeats included: ASCII lower case, split at ASCII white space."""
    words = text.encode().lower().split()
    joined, n = b" ".join(words), len(words)
    if n <= k:
        return [xxhash.xxh64_intdigest(joined, SEED)] if n else []
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    starts.append(at)
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b - 1], SEED) for a, b in zip(starts, starts[k:])]


def simhash(hashes: list[int]) -> int:
    """A bit is 1 if it is set in over half of the hashes; no hashes, zero."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at:at + (1 << 16)], dtype=np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def _fingerprint(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(shingle_hashes(t, k)) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(fps, pa.int64())], schema=FINGERPRINTS)

    return run


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of each row's whole text; fp holds the 64 bits as a signed integer."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(_fingerprint(shingle_words), ddl(FINGERPRINTS))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bit_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((BITS + 1, BITS), dtype=np.int64)
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 1 << 14):
            x = np.unpackbits(fps[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            sums[:BITS] += (x.T @ x).astype(np.int64)
            sums[BITS] += len(x)
    yield pa.record_batch([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], names=["cell", "n"])


def correlations(fps: DataFrame) -> np.ndarray:
    """|correlation| of every pair of bits over all fingerprints; only 65 x 64 sums reach the driver."""
    cells = fps.mapInArrow(_bit_sums, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n")).collect()
    sums = np.zeros((BITS + 1) * BITS)
    for cell, n in cells:
        sums[cell] = n
    sums = sums.reshape(BITS + 1, BITS)
    n = max(1.0, sums[BITS, 0])
    both, p = sums[:BITS] / n, np.diag(sums[:BITS]) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((both - np.outer(p, p)) / np.outer(spread, spread))


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """``m`` partitions of near-equal width: each starts at the free bit that goes most with the
    others and takes the bits that go most with it."""
    free, parts = set(range(BITS)), []
    for i in range(m):
        width = len(free) // (m - i)
        left = sorted(free)
        part = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        free.remove(part[0])
        while len(part) < width:
            best = max(sorted(free), key=lambda b: (corr[b, part].mean(), -b))
            part.append(best)
            free.remove(best)
        parts.append(sorted(part))
    return parts


def probes(width: int, threshold: int) -> int:
    return sum(math.comb(width, t) for t in range(threshold + 1))


def allot(widths: list[int], collisions: list[float], n: int, radius: int) -> tuple[float, list[int]]:
    """(cost, thresholds): the cheapest t_i >= -1 with sum(t_i + 1) = radius + 1.

    ``collisions``: pairs with equal bits in a partition. A threshold t probes that many times the
    values, each about as full, and shuffles as many rows.
    """
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(math.inf, [])] * (radius + 1)
    for width, pairs in zip(widths, collisions):
        after = [(math.inf, [])] * (radius + 2)
        for used, (cost, chosen) in enumerate(best):
            for t in range(-1, radius + 1 - used):
                many = probes(width, t)
                total = cost + (n * many * ROW_COST + pairs * many * many if many else 0.0)
                if total < after[used + t + 1][0]:
                    after[used + t + 1] = (total, [*chosen, t])
        best = after
    return best[radius + 1]


def plan(fps: DataFrame, radius: int) -> list[tuple[list[int], int]]:
    """The partitions (bits, threshold) to probe, the cheapest of several partitionings."""
    corr = correlations(fps)
    options = [group_bits(corr, m) for m in PARTITIONINGS]
    masks = [(o, i, sum(1 << b for b in part)) for o, parts in enumerate(options) for i, part in enumerate(parts)]
    projected = fps.select(F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"))
                                               for j, (_, _, mask) in enumerate(masks)))).alias("p")).select("p.*")
    counts = projected.groupBy("j", "key").count().groupBy("j").agg(F.sum("count"), F.sum(F.pow("count", F.lit(2.0)))).collect()
    n = max((c[1] for c in counts), default=1)
    squares = {c[0]: (c[2] - c[1]) / 2 for c in counts}
    found = []
    for o, parts in enumerate(options):
        pairs = [squares.get(j, 0.0) for j, (of, _, _) in enumerate(masks) if of == o]
        cost, thresholds = allot([len(p) for p in parts], pairs, n, radius)
        found.append((cost, [(p, t) for p, t in zip(parts, thresholds) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


def _flips(bits: list[int], threshold: int) -> list[int]:
    return [_signed(sum(1 << b for b in chosen)) for t in range(threshold + 1) for chosen in combinations(bits, t)]


def _link_dense(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what the bucket's pairs within the radius connect, found from pivots: what
    is near the pivot is one component, and only what lies within twice the radius of the pivot can
    have a link to it."""
    out, rest = [], fps
    while len(rest) > 1:
        d = np.bitwise_count((rest ^ rest[0]).view(np.uint64))
        near, ring, rest = rest[d <= radius], rest[(d > radius) & (d <= 2 * radius)], rest[d > radius]
        out.append((near[1:], np.full(len(near) - 1, near[0])))
        step = max(1, (1 << 21) // max(1, len(near)))
        for at in range(0, len(ring) if len(near) > 1 else 0, step):
            part = ring[at:at + step]
            linked = np.bitwise_count((near[:, None] ^ part[None, :]).view(np.uint64)) <= radius
            hit = linked.any(axis=0)
            out.append((part[hit], near[linked.argmax(axis=0)[hit]]))
    return out


def _link_small(key: np.ndarray, fp: np.ndarray, home: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within sorted small groups: compare each row with the one ``lag`` rows on, for all lags."""
    out, end = [], np.searchsorted(key, key, side="right")
    at, lag = np.arange(len(key)), 1
    while len(at := at[at + lag < end[at]]):
        a, b = at, at + lag
        hit = (home[a] | home[b]) & (np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)) <= radius)
        out.append((fp[a[hit]], fp[b[hit]]))
        lag += 1
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links, as stars around the least fingerprint."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    pairs = [(x, root(x)) for x in list(parent)]
    return [x for x, r in pairs if x != r], [r for x, r in pairs if x != r]


def _link(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.concat_tables(held)
        key, fp, home = (rows.column(c).to_numpy() for c in ("bucket", "fp", "home"))
        order = np.lexsort((fp, key))
        key, fp, home = key[order], fp[order], home[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        out = []
        for s, n in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP]):
            if home[s:s + n].any():
                out += _link_dense(np.unique(fp[s:s + n]), radius)
        small = np.repeat(sizes <= SMALL_GROUP, sizes)
        out += _link_small(key[small], fp[small], home[small], radius)
        a, b = np.concatenate([x for x, _ in out] or [[]]), np.concatenate([y for _, y in out] or [[]])
        a, b = _forest(a, b)
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_links(fps: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) that connect exactly those of the distinct fingerprints ``fp`` that a chain of
    pairs within ``radius`` bits connects."""
    if not 0 <= radius < BITS:
        raise ValueError("the radius must be at least 0 and below 64 bits")
    spark = fps.sparkSession
    parts = plan(fps, radius)
    cells = []
    for i, (bits, threshold) in enumerate(parts):
        mask = _signed(sum(1 << b for b in bits))
        for flip in _flips(bits, threshold):
            value = F.col("fp").bitwiseAND(F.lit(mask))
            cells.append(F.struct(F.lit(i).alias("part"), (value.bitwiseXOR(F.lit(flip)) if flip else value).alias("key"), F.lit(flip == 0).alias("home")))
    probed = fps.select("fp", F.explode(F.array(*cells)).alias("c")).select("fp", "c.*")
    # a second pigeonhole over the other bits divides the buckets that are too full for one task
    large = (probed.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_rows)
             .select("part", "key", F.lit(True).alias("large")))
    again = []
    for i, (bits, _) in enumerate(parts):
        other = [b for b in range(BITS) if b not in bits]
        blocks = [other[j::radius + 1] for j in range(radius + 1)]
        again.append(F.when(F.col("part") == i, F.array(*(F.xxhash64(F.lit(j), F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in block)))))
                                                         for j, block in enumerate(blocks)))))
    divided = (probed.join(large, ["part", "key"], "left")
               .withColumn("sub", F.explode(F.when(F.col("large"), F.coalesce(*again)).otherwise(F.array(F.lit(0).cast("bigint"))))))
    rows = divided.select(F.xxhash64("part", "key", "sub").alias("bucket"), "fp", "home")
    tasks = max(default_partitions(spark), fps.count() * len(cells) // 200_000)
    return rows.repartition(tasks, "bucket").mapInArrow(_link(radius), "a bigint, b bigint")


def near_groups(docs: DataFrame, radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per input row.

    Documents whose fingerprints a chain of steps of at most ``radius`` bits connects have one
    component, named by its smallest id. A text without words (null and empty too) has fingerprint
    zero and links like any other; a text of fewer words than a shingle is one shingle. Null ids are
    kept and name a component only if it has no other; an empty table gives no rows.
    """
    folder = scratch_folder(docs.sparkSession)
    marked = written(fingerprints(docs, shingle_words, id_col, text_col), folder, "fingerprints")
    n = marked.count()
    distinct = written(packed(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), n), folder, "distinct")
    roots = components(near_links(distinct.select("fp"), radius))
    rooted = (distinct.join(roots, distinct["fp"] == roots["node"], "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(packed(rooted.join(names, "root").select("fp", "component_id"), n), folder, "named")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id names their component. Rows that have
    no id stay where no row of their component has one, as nothing tells them apart."""
    groups = near_groups(docs, radius, shingle_words, id_col, text_col)
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col(id_col).cast("bigint").eqNullSafe(kept["kept_id"]), "left_semi")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_groups(table(spark, sf_dir, "documents"))
