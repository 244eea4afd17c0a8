"""Jaccard join of shingle sets by adaptive multi-match prefixes.

All shingles have one global order, the rarest first (document frequencies are exact counts over all
documents). If two sets overlap in at least T elements, their first ``n - T + l`` elements share at
least ``l``, for every l. A longer prefix costs more postings but asks for more matches, so each
document takes the l that minimises its estimated cost: the postings that its prefix meets, plus the
candidates that ``l`` matches leave of them (at most their number over l), each as dear as one exact
comparison. Two documents, whose sizes give T, are compared if the longest such prefixes that both have
posted share as many elements as their length asks for. Shingles that occur once bound the overlap, too.

1. **Classes.** Documents with the same shingle set (a 128-bit digest of the sorted set) are one class,
   with one row as representative, so that copies cost one row each and no more.
2. **Frequencies.** Representatives are handled in blocks of a few megabytes, stored as one compressed row
   each. Every block sends the
   distinct shingles it holds, with their counts, to the shingles' partitions as one packed array each,
   and gets their frequency classes back: a shingle in a third of all documents is one entry a block.
3. **Prefixes.** A document whose prefix holds only shingles that occur once has no partner. The others
   become postings: in a list by shingle and size as the smaller of a pair, and as the larger in the
   lists of all sizes that a partner can have.
4. **Links.** Only what connects is needed. While the postings of different components could meet in
   many pairs, every list is compared with a pivot only, first the document with the fewest shingles of
   its own, and linked classes become one component; thousands of near copies collapse in a round or two.
   Then all pairs left between different components are counted and compared.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import ddl, packed, release_shuffles, table, text_of, written
from tidepool.llm.components import components
from tidepool.session import default_partitions, scratch_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE_WORDS, PERCENT = 5, 80
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 1 << 14
#: Shingles a partition of the frequency count, about.
PART_SHINGLES = 1 << 20
#: An exact comparison costs as much as so many postings, plus one for so many shingles of the set.
COMPARE_COST, COMPARE_SHINGLES = 20.0, 16.0
#: Pairs that may be counted, for each posting, before another round of pivots is taken.
PAIRS_PER_POSTING = 0.25
#: Rows of a group of lists that are counted together; rows of a list that meet all its others at once.
GROUP_ROWS, LIST_ROWS = 1 << 18, 1 << 12
#: Links that one task joins up.
TASK_LINKS = 1 << 18
#: Lists by size between a set and its smallest partner.
SIZE_BANDS = 8

MARKS = pa.schema([("block", pa.int64()), ("uid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()),
                   ("k2", pa.int64()), ("texts", pa.binary())])
MESSAGES = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])
REPLIES = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("uid", pa.int64()), ("classes", pa.binary())])
ACTIVE = "uid bigint, n bigint, own bigint, ell bigint, tokens array<bigint>, shingles binary"
MIX, SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
CHUNK_BYTES = 1 << 20


def _scrambled(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers whose every output bit depends on every input bit."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte, the same for A-Z and a-z; which bytes are white space.
CODES = _scrambled(np.arange(1, 257, dtype=np.uint64) * MIX)
CODES[65:91] = CODES[97:123]
WORD_BYTE = np.ones(256, dtype=bool)
WORD_BYTE[[32, *range(9, 14)]] = False


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ASCII-lower-cased bytes, and where the words start."""
    inside = WORD_BYTE[data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(firsts[-1] + lengths[-1]) - np.repeat(firsts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), MIX, dtype=np.uint64))
    sums = np.add.reduceat(CODES[data[inside]] * powers[place], firsts)
    return _scrambled(sums + lengths.astype(np.uint64)), starts


def _words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, and the number of the words before each text and in all."""
    joined = b"\n".join(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    hashes, starts, at = [], [], 0
    while at < len(joined):  # pieces end behind white space
        stop = at + CHUNK_BYTES
        while stop < len(joined) and WORD_BYTE[joined[stop - 1]]:
            stop += 1
        h, s = word_hashes(np.frombuffer(joined, dtype=np.uint8, count=min(stop, len(joined)) - at, offset=at))
        hashes.append(h)
        starts.append(s + at)
        at = stop
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.concatenate(hashes), np.r_[0, np.searchsorted(np.concatenate(starts), ends)]


def _runs(w: np.ndarray, at: np.ndarray | slice, n: int, span: int) -> np.ndarray:
    """Hashes of the runs of ``span`` words that start at ``at``."""
    h = np.full(n, span, dtype=np.uint64)
    for i in range(span):
        h = (h ^ (w[at.start + i:at.stop + i] if isinstance(at, slice) else w[at + i])) * MIX
        h ^= h >> SHIFT
    return h


def _distinct(ascending: np.ndarray) -> np.ndarray:
    return ascending[np.r_[True, ascending[1:] != ascending[:-1]]] if len(ascending) else ascending


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its runs of ``k`` words (ASCII lower case, split
    at ASCII white space); fewer words are one run, none give the empty set."""
    at = 0
    while at < len(texts):
        stop, held = at + 1, len(texts[at])
        while stop < len(texts) and held < CHUNK_BYTES:
            held, stop = held + len(texts[stop]), stop + 1
        w, bounds = _words_of(texts[at:stop])
        full = _runs(w, slice(0, max(0, len(w) - k + 1)), max(0, len(w) - k + 1), k)
        for first, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if end - first >= k:
                yield _distinct(np.sort(full[first:end - k + 1]))
            elif end > first:
                yield _runs(w, np.array([first]), 1, end - first)
            else:
                yield np.zeros(0, dtype=np.uint64)
        at = stop


def packed_texts(texts: list[bytes]) -> bytes:
    """The texts of a block, compressed together behind their lengths."""
    lengths = np.array([len(texts), *map(len, texts)], dtype="<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(lengths + b"".join(texts))


def unpacked_texts(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, dtype="<i8", count=1)[0])
    ends = 8 * (n + 1) + np.r_[0, np.cumsum(np.frombuffer(raw, dtype="<i8", count=n, offset=8))]
    return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _mark(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, rows = None, 0, []

        def whole() -> pa.RecordBatch:
            """The block's texts, as a row without a set."""
            row = ([block], [None], [None], [-1], [None], [None], [packed_texts(rows)])
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(row, MARKS)], schema=MARKS)

        for batch in batches:
            cols, full = [[] for _ in range(5)], []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for part, text, found in zip(batch.column("part").to_pylist(), texts, shingle_sets(texts, k)):
                if block is None:
                    block = part << 16
                elif held >= BLOCK_BYTES or len(rows) >= BLOCK_ROWS:
                    full.append(whole())
                    block, held, rows = block + 1, 0, []
                k1, k2 = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), dtype=np.int64).tolist()
                for c, v in zip(cols, (block, (block << 14) + len(rows), len(found), k1, k2)):
                    c.append(v)
                held += len(text)
                rows.append(text)
            blocks, uids, n, k1s, k2s = (pa.array(c, pa.int64()) for c in cols)
            yield pa.record_batch([blocks, uids, batch.column("doc_id"), n, k1s, k2s, pa.nulls(len(n), pa.binary())], schema=MARKS)
            yield from full
        if rows:
            yield whole()

    return run


def pack(ascending: np.ndarray) -> bytes:
    """Ascending unsigned integers as the byte planes of their differences, as many as those need."""
    d = np.diff(ascending, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(d.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(blob, dtype=np.uint8, offset=1).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    wide[:, :width] = planes.T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def _representatives(stored: pa.Table, uids: list[int], k: int) -> tuple[list[int], list[np.ndarray]]:
    """The block's representatives in order of their number, with their shingles."""
    order, texts = sorted(uids), unpacked_texts(stored.column("texts")[0].as_py())
    return order, list(shingle_sets([texts[u & (BLOCK_ROWS - 1)] for u in order], k))


def _ids(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Shingles are ordered and matched by their first ``bits`` bits. Two of a document's may so become
    one, in all documents alike, which the bound on prefixes survives: its length is that of the set."""
    return _distinct(shingles >> np.uint64(64 - bits))


def _send(k: int, bits: int, part_bits: int):
    def run(stored: pa.Table, reps: pa.Table) -> pa.Table:
        if not (stored.num_rows and reps.num_rows):
            return MESSAGES.empty_table()
        _, sets = _representatives(stored, reps.column("uid").to_pylist(), k)
        ids, counts = np.unique(np.concatenate([_ids(s, bits) for s in sets]), return_counts=True)
        low = np.uint64(bits - part_bits)
        cuts = np.searchsorted(ids, np.arange((1 << part_bits) + 1, dtype=np.uint64) << low)
        at = [p for p in range(1 << part_bits) if cuts[p] < cuts[p + 1]]
        block = stored.column("block")[0].as_py()
        return pa.table([at, [block] * len(at), [pack(ids[cuts[p]:cuts[p + 1]] & ((np.uint64(1) << low) - np.uint64(1))) for p in at],
                         [counts[cuts[p]:cuts[p + 1]].astype("<u2").tobytes() for p in at]], schema=MESSAGES)

    return run


def frequency_class(n: np.ndarray) -> np.ndarray:
    """0 for what occurs once; else a step of a quarter of a doubling."""
    return np.where(n > 1, 1 + np.floor(4 * np.log2(np.maximum(n, 1))), 0).clip(0, 255).astype(np.uint8)


def class_frequency(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.exp2((c.astype(np.float64) - 1) / 4), 1.0)


def _count(messages: pa.Table) -> pa.Table:
    """One partition's frequency classes, for each block in the order in which it sent them."""
    ids = [unpack(b) for b in messages.column("ids").to_pylist()]
    counts = np.concatenate([np.frombuffer(b, dtype="<u2") for b in messages.column("counts").to_pylist()])
    _, of = np.unique(np.concatenate(ids), return_inverse=True)
    classes = frequency_class(np.bincount(of, weights=counts))[of]
    ends = np.cumsum([len(x) for x in ids])
    return pa.table([messages.column("block"), messages.column("part"), pa.nulls(len(ids), pa.int64()),
                     pa.array([classes[e - len(x):e].tobytes() for x, e in zip(ids, ends)], pa.binary())], schema=REPLIES)


def least_overlap(n: int, percent: int) -> int:
    """A set of ``n`` elements shares at least so many with any that it links with."""
    return -(-n * percent // 100)


def choose_length(n: int, unique: int, frequencies: np.ndarray, percent: int) -> tuple[int, int]:
    """(l, number of the non-unique elements, the rarest first, in the prefix): the cheapest l.

    ``unique``: elements that occur nowhere else; they come first. A prefix of n - t + l elements
    meets ``sum(frequency - 1)`` postings; at most that number over l have l matches.
    """
    t = least_overlap(n, percent)
    base = n - t
    if unique > base:  # all of the shortest prefix occurs nowhere else
        return 1, 0
    met = np.cumsum(frequencies - 1)
    ells = np.arange(1, t + 1)
    taken = np.minimum(base + ells - unique, len(frequencies))
    cost = met[taken - 1] * (1 + (COMPARE_COST + n / COMPARE_SHINGLES) / ells)
    best = int(np.argmin(cost))
    return best + 1, int(taken[best])


def _prefixes(k: int, bits: int, percent: int):
    schema = pa.schema([("uid", pa.int64()), ("n", pa.int64()), ("own", pa.int64()), ("ell", pa.int64()), ("tokens", pa.list_(pa.int64())),
                        ("shingles", pa.binary())])

    def run(stored: pa.Table, replies: pa.Table) -> pa.Table:
        if not (stored.num_rows and replies.num_rows):
            return schema.empty_table()
        replies = replies.sort_by("part")
        reps = [u for u in replies.column("uid").to_pylist() if u is not None]
        classes = np.frombuffer(b"".join(b for b in replies.column("classes").to_pylist() if b is not None), dtype=np.uint8)
        order, sets = _representatives(stored, reps, k)
        own = [_ids(s, bits) for s in sets]
        block_ids, rows = np.unique(np.concatenate(own)), []
        for uid, shingles, ids in zip(order, sets, own):
            found = classes[np.searchsorted(block_ids, ids)]
            shared = np.flatnonzero(found)
            shared = shared[np.argsort(found[shared], kind="stable")]  # the rarest first, ties by the shingle
            unique = len(ids) - len(shared)
            ell, taken = choose_length(len(shingles), unique, class_frequency(found[shared]), percent) if len(shared) else (1, 0)
            if taken:
                rows.append((uid, len(shingles), unique, ell, ids[shared[:taken]].astype(np.int64), shingles.tobytes()))
        cols = list(zip(*rows)) or [[]] * len(schema)
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, keep = batch.column("set_a"), batch.column("set_b"), []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), dtype=np.uint64) for c in (a, b))
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link. A set with many partners is on the side that a skew join copies."""
    left = sets.select(F.col("uid").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("uid").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(_verify(percent), "a bigint, b bigint")


def _ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b)


def _overlap(total: Column, percent: int) -> Column:
    """The least overlap of two linked sets of so many elements in all."""
    return _ceil_div(percent * total, 100 + percent)


def size_lists(active: DataFrame, percent: int) -> DataFrame:
    """Postings (token, band, large, uid, n, own, at, spare): the sets as the smaller and as the larger of a pair.

    ``at``: the token's place in its set; ``own``: elements that occur nowhere else; ``spare``: a pair
    with overlap T has posted its prefixes for ``T + spare`` matches. A set posts no more than its
    partners' sizes ask for: as the smaller one, T is at least that of two equal sizes, and its own
    elements may not take more than the rest; as the larger one these bound its partner's size. Lists
    that only one set is in are left out.
    """
    rows = active.select("uid", "n", "own", "ell", "tokens")
    step = max(math.log(100 / percent), 1e-3) / SIZE_BANDS
    band = lambda n: F.floor(F.log(n.cast("double")) / step)
    even, least, most = _overlap(2 * F.col("n"), percent), _ceil_div(percent * F.col("n"), 100), F.floor((F.col("n") - F.col("own")) * (100 + percent) / percent) - F.col("n")
    small = (rows.withColumn("spare", F.col("ell") - even).filter(F.col("n") - F.col("own") >= even)
             .withColumn("tokens", F.slice("tokens", F.lit(1), F.greatest(F.lit(0).cast("bigint"), F.col("n") + F.col("spare") - F.col("own")).cast("int"))))
    small = small.select("uid", "n", "own", "spare", band(F.col("n")).alias("band"), F.posexplode("tokens").alias("j", "token"))
    large = rows.withColumn("spare", F.col("ell") - least).withColumn("most", F.least("n", most)).filter(F.col("most") >= least)
    large = large.select("uid", "n", "own", "spare", F.sequence(band(least), band(F.col("most"))).alias("fit"), F.posexplode("tokens").alias("j", "token"))
    # the sizes there are in a token's lists: no more than sizes differ
    there = small.groupBy(F.col("token").alias("t")).agg(F.collect_set("band").alias("there"))
    large = large.join(there, F.col("token") == F.col("t")).withColumn("band", F.explode(F.array_intersect("fit", "there")))
    columns = ["token", "band", "uid", "n", "own", (F.col("own") + F.col("j")).alias("at"), "spare"]
    both = small.select(*columns, F.lit(False).alias("large")).unionByName(large.select(*columns, F.lit(True).alias("large")))
    lists = both.groupBy(F.col("token").alias("t"), F.col("band").alias("d")).agg(F.min("uid").alias("lo"), F.max("uid").alias("hi")).filter("lo < hi")
    return both.join(lists.select("t", "d"), (F.col("token") == F.col("t")) & (F.col("band") == F.col("d"))).drop("t", "d")


def _labelled(postings: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The postings as the smaller and as the larger set, with the component so far."""
    if labels is None:
        rows = postings.withColumn("label", F.col("uid"))
    else:
        rows = postings.join(labels, F.col("uid") == F.col("node"), "left").withColumn("label", F.coalesce("root", "uid")).drop("node", "root")
    return rows.filter("not large"), rows.filter("large")


def _pivot_pairs(small: DataFrame, large: DataFrame, percent: int, turn: int) -> DataFrame:
    """Candidates where one is the pivot of lists that both are in, often enough to pass."""
    first = F.col("own") if turn == 1 else F.lit(0).cast("bigint")
    best = F.min(F.struct(first.alias("f"), F.xxhash64(F.lit(turn), "uid").alias("h"), "uid", "label", "n", "own", "at", "spare")).alias("p")
    pivots = small.groupBy(F.col("token").alias("t"), F.col("band").alias("d")).agg(best)
    met = large.join(pivots, (F.col("token") == F.col("t")) & (F.col("band") == F.col("d")) & (F.col("label") != F.col("p.label")) & _fitting(percent))
    return _matched(met, percent)


_COUNTED = "a bigint, b bigint, need bigint, shared bigint"


def _count_pairs(percent: int):
    """The pairs of one group of lists, with the matches that they have there: only those that can still
    reach what they need with the postings (``rest``) that either set has in other groups."""
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("token", "ascending"), ("band", "ascending")])
        token, band, uid, label, n, own, at, spare, everywhere = (group.column(c).to_numpy() for c in ("token", "band", "uid", "label", "n", "own", "at", "spare", "everywhere"))
        large = group.column("large").to_numpy()
        # what a set has posted in other groups, as the smaller or the larger one, by the partners' size
        order = np.lexsort((large, band, uid))
        new = np.r_[True, np.any([x[order[1:]] != x[order[:-1]] for x in (large, band, uid)], axis=0)]
        same = np.empty(len(uid), dtype=np.int64)
        same[order] = np.cumsum(new) - 1
        rest = everywhere - np.bincount(same)[same]
        names, doc = np.unique(uid, return_inverse=True)
        cuts = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (band[1:] != band[:-1]), True])
        codes, rows = [], []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            big, few = lo + np.flatnonzero(large[lo:hi]), lo + np.flatnonzero(~large[lo:hi])
            for i in range(0, len(big), 1 << 10):
                x, y = big[i:i + (1 << 10), None], few[None, :]
                less = np.minimum(spare[x], spare[y])
                total = -(-percent * (n[x] + n[y]) // (100 + percent))
                fits = ((label[x] != label[y]) & ((n[x] > n[y]) | ((n[x] == n[y]) & (uid[x] > uid[y]))) & (total <= n[x] - own[x]) & (total <= n[y] - own[y])
                        & (at[x] < n[x] + less) & (at[y] < n[y] + less))
                p, q = np.nonzero(fits)
                codes.append(doc[big[i + p]] * len(names) + doc[few[q]])
                rows.append(np.column_stack([big[i + p], few[q]]))
        codes, rows = np.concatenate(codes or [np.zeros(0, dtype=np.int64)]), np.concatenate(rows or [np.zeros((0, 2), dtype=np.int64)])
        _, first, shared = np.unique(codes, return_index=True, return_counts=True)
        x, y = rows[first].T
        need = -(-percent * (n[x] + n[y]) // (100 + percent)) + np.minimum(spare[x], spare[y])
        kept = shared + np.minimum(rest[x], rest[y]) >= need
        return pa.table({"a": uid[x][kept], "b": uid[y][kept], "need": need[kept], "shared": shared[kept]})

    return run


def _all_pairs(small: DataFrame, large: DataFrame, percent: int, list_rows: int = LIST_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Candidates of different components: all of them.

    Lists with one pivot, whose sets share most of their lists, are counted together, so that a pair is a
    row for a group and not for a shingle. Groups of more than ``group_rows`` rows are divided by shingle,
    lists of more than ``list_rows`` into squares of parts of their larger and smaller sets.
    """
    both = small.withColumn("large", F.lit(False)).unionByName(large.withColumn("large", F.lit(True)))
    central = F.min(F.struct("own", F.xxhash64("uid").alias("h"), "uid")).getField("uid").alias("pivot")
    lists = (both.groupBy(F.col("token").alias("t"), F.col("band").alias("d")).agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"), central)
             .filter("lo < hi").select("t", "d", "pivot", F.ceil(F.col("m") / list_rows).alias("parts"), "m"))
    sizes = lists.groupBy(F.col("pivot").alias("v")).agg(F.ceil(F.sum("m") / group_rows).alias("ways"))
    lists = lists.join(sizes, F.col("pivot") == F.col("v")).select("t", "d", "parts", F.xxhash64("pivot", F.pmod(F.xxhash64("t"), F.col("ways"))).alias("g"))
    rows = both.join(lists, (F.col("token") == F.col("t")) & (F.col("band") == F.col("d"))).drop("t", "d")
    posted = rows.groupBy(F.col("uid").alias("u"), F.col("band").alias("d"), F.col("large").alias("l")).agg(F.count("*").alias("everywhere"))
    rows = rows.join(posted, (F.col("uid") == F.col("u")) & (F.col("band") == F.col("d")) & (F.col("large") == F.col("l"))).drop("u", "d", "l")
    # a square of parts for each pair of a larger and a smaller set's part
    own_part, others = F.pmod(F.xxhash64("uid"), F.col("parts")), F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)
    rows = rows.withColumn("other", F.explode(others)).withColumn("square", F.when(F.col("parts") == 1, F.col("g")).otherwise(
        F.xxhash64("g", "token", "band", F.when(F.col("large"), own_part).otherwise(F.col("other")), F.when(F.col("large"), F.col("other")).otherwise(own_part))))
    counted = rows.select("square", "token", "band", "uid", "label", "n", "own", "at", "spare", "large", "everywhere").groupBy("square").applyInArrow(_count_pairs(percent), _COUNTED)
    return counted.groupBy("a", "b", "need").agg(F.sum("shared").alias("shared")).filter("shared >= need").select("a", "b")


def _fitting(percent: int) -> Column:
    """Whether a posting of the larger set and one (``p``) of the smaller can count for their pair."""
    total = _overlap(F.col("n") + F.col("p.n"), percent)
    spare = F.least("spare", "p.spare")  # prefixes for total + spare matches end at n + spare
    return ((F.col("p.n") <= F.col("n")) & (total <= F.col("n") - F.col("own")) & (total <= F.col("p.n") - F.col("p.own"))
            & (F.col("at") < F.col("n") + spare) & (F.col("p.at") < F.col("p.n") + spare))


def _matched(met: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that match as often as the prefixes which both have posted ask for."""
    need = _overlap(F.col("n") + F.col("p.n"), percent) + F.least("spare", "p.spare")
    return (met.groupBy(F.col("uid").alias("a"), F.col("p.uid").alias("b"), need.alias("need"))
            .agg(F.count("*").alias("shared")).filter("shared >= need").select("a", "b"))


def _open_pairs(small: DataFrame, large: DataFrame) -> tuple[int, int]:
    """(postings, pairs of postings of different components in one list)."""
    zero, one = F.lit(0.0), F.lit(1.0)
    both = small.select("token", "band", "label", one.alias("s"), zero.alias("l")).union(large.select("token", "band", "label", zero, one))
    sizes = both.groupBy("token", "band", "label").agg(F.sum("s").alias("s"), F.sum("l").alias("l"))
    lists = sizes.groupBy("token", "band").agg(F.sum("s").alias("s"), F.sum("l").alias("l"), F.sum(F.col("s") * F.col("l")).alias("same"))
    n, pairs = lists.agg(F.sum(F.col("s") + F.col("l")), F.sum(F.col("s") * F.col("l") - F.col("same"))).first()
    return int(n or 0), int(pairs or 0)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the links of one task, the root being the least node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)
    yield pa.record_batch([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in parent], pa.int64())], names=["node", "root"])


def link_components(links: DataFrame, n_links: int, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, root) of all linked classes: by one task's union-find up to ``task_links`` links, counted
    before; by alternating stars over all tasks beyond."""
    if n_links > task_links:
        return components(links)
    return links.coalesce(1).mapInArrow(_forest, "node bigint, root bigint")


def link_classes(active: DataFrame, percent: int = PERCENT, pairs_per_posting: float = PAIRS_PER_POSTING, task_links: int = TASK_LINKS) -> DataFrame | None:
    """(node, root) of the classes that links connect, or None if there is no link.

    ``active``: (uid, n, own, ell, tokens, shingles). All links are found that join different
    components; of those inside a component, what the rounds needed.
    """
    folder, labels, links, turn, before = scratch_folder(active.sparkSession), None, None, 0, math.inf
    postings = written(size_lists(active, percent), folder, "postings")
    release_shuffles(active.sparkSession)
    n_links = 0
    while True:
        small, large = _labelled(postings, labels)
        n, pairs = _open_pairs(small, large)
        if not pairs:
            return labels
        last = pairs <= pairs_per_posting * n or (turn > 1 and pairs > 0.75 * before)
        before, turn = pairs, turn + 1
        found = _all_pairs(small, large, percent) if last else _pivot_pairs(small, large, percent, turn)
        candidates = written(found, folder, f"candidates-{turn}")
        new = written(packed(verified(candidates, active.select("uid", "shingles"), percent), candidates.count()), folder, f"links-{turn}")
        more = new.count()
        if more:
            links, n_links = new if links is None else links.union(new), n_links + more
            labels = written(link_components(links, n_links, task_links), folder, f"labels-{turn}")
        if last:
            return labels


def jaccard_components(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
                       pairs_per_posting: float = PAIRS_PER_POSTING) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per input row.

    A document's set holds the distinct runs of ``shingle_words`` words (A-Z lower-cased, split at ASCII
    white space) of its whole text; a text of fewer words is one shingle. Two documents link when
    ``100 * intersection >= percent * union``; component_id is the smallest id that links reach. A text
    without words (null and empty too) has no shingles, links with nothing and names itself. Repeated
    rows are copies of each other; null ids are kept and name a component only if it has no other; an
    empty table gives no rows. Other columns are not read.
    """
    if not 0 < percent <= 100:
        raise ValueError("the similarity must be above 0 and at most 100 percent")
    spark = docs.sparkSession
    folder = scratch_folder(spark)
    rows = docs.select(F.spark_partition_id().cast("bigint").alias("part"), F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    stored = written(rows.mapInArrow(_mark(shingle_words), ddl(MARKS)), folder, "marks")
    classes = written(stored.filter("n > 0").groupBy("k1", "k2").agg(F.min("uid").alias("uid"), F.min("n").alias("n"), F.min("doc_id").alias("least")), folder, "classes")
    n_classes, n_shingles = (int(x or 0) for x in classes.agg(F.count("*"), F.sum("n")).first())

    part_bits = max(3, math.ceil(math.log2(max(1, n_shingles) / PART_SHINGLES)))
    bits = min(62, max(40, math.ceil(math.log2(max(2, n_shingles))) + 12))
    texts = stored.filter("n < 0").select("block", "texts")
    reps = classes.select(F.shiftright("uid", 14).alias("block"), "uid")
    sent = texts.groupBy("block").cogroup(reps.groupBy("block")).applyInArrow(_send(shingle_words, bits, part_bits), ddl(MESSAGES))
    counted = sent.repartition(max(default_partitions(spark), (1 << part_bits) // 2), "part").groupBy("part").applyInArrow(_count, ddl(REPLIES))
    replies = written(counted, folder, "replies")
    del sent, counted  # what holds on to their shuffles
    release_shuffles(spark)
    asked = replies.unionByName(reps.select("block", F.lit(-1).cast("bigint").alias("part"), "uid", F.lit(None).cast("binary").alias("classes")))
    prefixes = texts.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_prefixes(shingle_words, bits, percent), ACTIVE)
    active = written(prefixes, folder, "prefixes")
    del prefixes
    release_shuffles(spark)

    labels = link_classes(active, percent, pairs_per_posting)
    rooted = classes.select("k1", "k2", "uid", "least")
    if labels is None:
        named = rooted.withColumnRenamed("least", "component_id")
    else:
        rooted = rooted.join(labels, F.col("uid") == F.col("node"), "left").select("k1", "k2", "least", F.coalesce("root", "uid").alias("root"))
        names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        named = rooted.join(names, "root")
    named = written(packed(named.select("k1", "k2", "component_id"), n_classes), folder, "named")
    release_shuffles(spark)
    found = stored.select("doc_id", "n", "k1", "k2").filter("n > 0").join(named, ["k1", "k2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    # a block's own row has n = -1
    return found.union(stored.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document."""
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = f"""
with recursive w as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words
  from documents),
s as (
  select distinct r, array_to_string(words[i:i + least(len(words), {SHINGLE_WORDS}) - 1], ' ') as shingle
  from (select r, words, unnest(range(1, len(words) - least(len(words), {SHINGLE_WORDS}) + 2)) as i from w where len(words) > 0)),
n as (select r, count(*) as n from s group by r),
pairs as (select a.r as a, b.r as b, count(*) as shared from s a join s b on a.shingle = b.shingle and a.r <> b.r group by a.r, b.r),
links as (select a, b from pairs join n x on x.r = a join n y on y.r = b where 100 * shared >= {PERCENT} * (x.n + y.n - shared)),
reach as (select r as a, r as b from w union select reach.a, links.b from reach join links on links.a = reach.b)
select w.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(other.doc_id) as component_id
from w left join n on n.r = w.r join reach on reach.a = w.r join w other on other.r = reach.b
group by w.r, w.doc_id"""
