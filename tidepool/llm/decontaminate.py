"""Benchmark decontamination with SimHash windows.

For every number of words that a benchmark item has, each window of so many words of a document gets a
SimHash of its five-word shingles. Hamming blocks give all items of that size within ``radius`` bits:
the 64 bits are cut into blocks, and a fingerprint within the radius is within radius // blocks bits in
at least one. Candidates are verified by the exact weighted similarity of their shingles (weight:
how often a shingle occurs; sum of minima over sum of maxima). A document with fewer words than an
item is one window of its own size, compared with the items without fingerprints: sums over
different numbers of shingles differ in more bits, and it is one window only.

A window that shares too few shingles with the items of its size to reach the similarity with any of
them is not fingerprinted, so the work follows the passages that documents share with the benchmark. Items are taken in blocks of
bounded size, measured before they are broadcast; every block is matched against all documents.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import ddl, filter_rows, table, text_of, texts_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE_WORDS, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 24, 16
BLOCK_BYTES = 4 << 20
CACHE_WORDS = 1 << 20
FILTER_BITS = 18
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64())])


class WordHashes:
    """64-bit hashes of a text's words: lower case, without ASCII punctuation at either end."""

    def __init__(self) -> None:
        self.cache: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words, cache = text.split(), self.cache
        for word in set(words).difference(cache):
            plain = word.lower().strip(EDGES)
            cache[word] = xxhash.xxh3_64_intdigest(plain) | 1 if plain else 0
        out = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
        if len(cache) > CACHE_WORDS:
            cache.clear()
        return out[out != 0]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = (h ^ words[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted known ones."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _signs(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return 2 * bits.astype(np.int32) - 1


def window_fingerprints(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` shingles at ``starts``; a bit is 1 if its sum is positive."""
    low = int(starts[0])
    sums = np.zeros((int(starts[-1]) - low + size + 1, 64), dtype=np.int32)
    np.cumsum(_signs(hashes[low:low + len(sums) - 1]), axis=0, out=sums[1:])
    at = starts - low
    return np.packbits(sums[at + size] - sums[at] > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def weighted_similarity(a: Counter, b: Counter) -> float:
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


class SizeIndex:
    """The items of one number of words: their shingles and Hamming blocks of their fingerprints."""

    def __init__(self, n_words: int, k: int, items: list[tuple[tuple, np.ndarray]], radius: int, blocks: int):
        self.n_words, self.k, self.size, self.radius = n_words, k, n_words - k + 1, radius
        self.ids = [i for i, _ in items]
        self.weights = [Counter(h.tolist()) for _, h in items]
        self.known = np.unique(np.concatenate([h for _, h in items]))
        self.fps = np.concatenate([window_fingerprints(h, np.zeros(1, dtype=np.int64), self.size) for _, h in items])
        self.width, self.blocks = 64 // blocks, blocks
        # by block and value: which items are within radius // blocks bits there
        values = np.arange(1 << self.width, dtype=np.uint64)
        self.near = [np.bitwise_count(values[:, None] ^ self._block(self.fps, b)[None, :]) <= radius // blocks for b in range(blocks)]

    def _block(self, fps: np.ndarray, b: int) -> np.ndarray:
        return (fps >> np.uint64(b * self.width)) & np.uint64((1 << self.width) - 1)

    def candidates(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs within the radius: probe the blocks, then count the bits."""
        probed = np.zeros((len(fps), len(self.ids)), dtype=bool)
        for b, near in enumerate(self.near):
            probed |= near[self._block(fps, b)]
        window, item = np.nonzero(probed)
        close = np.bitwise_count(fps[window] ^ self.fps[item]) <= self.radius
        return window[close], item[close]


class BenchmarkIndex:
    """All sizes of one block of items, and a filter for their shingles."""

    def __init__(self, items: list[tuple[tuple, str]], k: int, radius: int, blocks: int):
        hash_words, by_size = WordHashes(), {}
        for item_id, text in items:
            words = hash_words(text)
            if len(words):
                short = min(k, len(words))
                by_size.setdefault(len(words), []).append((item_id, shingles(words, short)))
        self.sizes: dict[int, list[SizeIndex]] = {}
        for n, found in sorted(by_size.items()):
            index = SizeIndex(n, min(k, n), found, radius, blocks)
            self.sizes.setdefault(index.k, []).append(index)
        self.filters = {}
        for short, indexes in self.sizes.items():
            known = np.unique(np.concatenate([x.known for x in indexes]))
            table = np.zeros(1 << FILTER_BITS, dtype=bool)
            table[known >> np.uint64(64 - FILTER_BITS)] = True
            self.filters[short] = (known, table)

    def leaks(self, words: np.ndarray, similarity: float) -> list[tuple[tuple, float, int, int]]:
        """((item, times), similarity, first word, words) of the best window of each item found in a document."""
        out = []
        for k, indexes in self.sizes.items():
            hashes = shingles(words, k)
            known, table = self.filters[k]
            at = np.flatnonzero(table[hashes >> np.uint64(64 - FILTER_BITS)])
            at = at[is_in(hashes[at], known)]
            if not len(at):
                continue
            for index in indexes:
                own = at[is_in(hashes[at], index.known)]
                if len(own) and len(hashes) >= index.size:
                    out += self._of_size(index, hashes, own, similarity)
                elif len(own):
                    out += self._of_short(index, hashes, own, similarity)
        return out

    @staticmethod
    def _of_short(index: SizeIndex, hashes: np.ndarray, own: np.ndarray, similarity: float) -> list[tuple[tuple, float, int, int]]:
        """The same for a document with fewer words than the items: it is one window."""
        # shared / (len(hashes) + size - shared) >= similarity needs so many shared shingles
        if len(own) < similarity * (len(hashes) + index.size) / (1 + similarity) - 1e-9:
            return []
        weights = Counter(hashes.tolist())
        found = [weighted_similarity(w, weights) for w in index.weights]
        return [(item, x, 0, len(hashes) + index.k - 1) for item, x in zip(index.ids, found) if x and x >= similarity]

    @staticmethod
    def _of_size(index: SizeIndex, hashes: np.ndarray, own: np.ndarray, similarity: float) -> list[tuple[tuple, float, int, int]]:
        covered = np.zeros(len(hashes) - index.size + 2, dtype=np.int64)
        np.add.at(covered, np.clip(own - index.size + 1, 0, len(covered) - 1), 1)
        np.add.at(covered, np.clip(own + 1, 0, len(covered) - 1), -1)
        # shared / (2 * size - shared) >= similarity needs so many shared shingles
        needed = max(1, math.ceil(2 * similarity * index.size / (1 + similarity) - 1e-9))
        starts, best = np.flatnonzero(np.cumsum(covered)[:-1] >= needed), {}
        # neighbouring windows share their running sums; far apart ones are taken apart
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > index.size) + 1) if len(starts) else []:
            for chunk in np.array_split(run, -(-len(run) // 8192)):
                windows, items = index.candidates(window_fingerprints(hashes, chunk, index.size))
                for window, item in zip(chunk[windows].tolist(), items.tolist()):
                    if best.get(item, (0.0,))[0] == 1.0:
                        continue
                    found = weighted_similarity(index.weights[item], Counter(hashes[window:window + index.size].tolist()))
                    if found >= similarity and found > best.get(item, (0.0,))[0]:
                        best[item] = (found, window)
        return [(index.ids[item], found, window, index.n_words) for item, (found, window) in sorted(best.items())]


def _match(items, k: int, radius: int, blocks: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_words, index = WordHashes(), None
        for batch in batches:
            index = index or BenchmarkIndex(items.value, k, radius, blocks)
            out = [(doc_id, item_id, *leak) for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                   for (item_id, times), *leak in index.leaks(hash_words(text), similarity) for _ in range(times)]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(LEAKS), LEAKS)], schema=LEAKS)

    return run


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The items, each once with the number of its rows (``times``), in blocks of about ``block_bytes``
    of text; the sizes are counted, not guessed."""
    benchmark = benchmark.groupBy("item_id", "text").agg(F.count("*").alias("times"))
    blocks = max(1, -(-int(benchmark.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]) // block_bytes))
    while True:
        dealt = benchmark.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
        held = dealt.groupBy("block").agg(F.sum(F.octet_length("text") + 16).alias("held"), F.count("*").alias("n"))
        if held.filter((F.col("held") > 2 * block_bytes) & (F.col("n") > 1)).isEmpty() or blocks > 1 << 20:
            return [dealt.filter(F.col("block") == b).drop("block") for b in range(blocks)]
        blocks *= 2


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, radius: int = RADIUS,
               blocks: int = BLOCKS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): the benchmark items that a document holds.

    A row per document row and item with a window of the item's size whose weighted shingle
    similarity is at least ``similarity``; the first best window. A document with fewer words than the
    item is one window of all its words (``n_words`` of them). Words are lower-cased and freed of
    ASCII punctuation at their ends; an item shorter than a shingle is one shingle; texts without
    words (null, empty) match nothing. Repeated documents and items give a row each, null ids are
    kept, empty tables give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    found = [rows.mapInArrow(_match(held, shingle_words, radius, blocks, similarity), ddl(LEAKS))
             for held in _broadcast_blocks(spark, benchmark, item_col, item_text_col, radius, blocks, block_bytes)]
    return reduce(DataFrame.unionByName, found)


def _broadcast_blocks(spark: SparkSession, benchmark: DataFrame, item_col: str, item_text_col: str, radius: int, blocks: int, block_bytes: int) -> list:
    if 64 % blocks or not 0 <= radius < 64:
        raise ValueError("the number of blocks must divide 64, the radius must be below 64")
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), text_of(item_text_col).alias("text"))
    return [spark.sparkContext.broadcast(sorted((((r["item_id"], r["times"]), r["text"]) for r in block.collect()), key=str)) for block in item_blocks(items, block_bytes)]


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item (as :func:`find_leaks`)."""
    for held in _broadcast_blocks(docs.sparkSession, benchmark, item_col, item_text_col, radius, blocks, block_bytes):
        docs = filter_rows(docs, _marker(held, text_col, shingle_words, radius, blocks, similarity))
    return docs


def _marker(items, text_col: str, k: int, radius: int, blocks: int, similarity: float):
    def make():
        hash_words, index = WordHashes(), BenchmarkIndex(items.value, k, radius, blocks)
        return lambda batch: [not index.leaks(hash_words(t), similarity) for t in texts_of(batch, text_col)]

    return make


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
