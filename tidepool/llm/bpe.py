"""Byte-level BPE encoding and decoding with overlapping chunks.

Texts above ``chunk_chars`` characters are cut into overlapping chunks, which Spark deals to all
tasks and which are pre-tokenised apart from each other. A chunk's first pre-tokens may be wrong,
as it can start inside one; but the pattern looks only ahead, so from a boundary that two chunks
have in common their pre-tokens are the same. The stitch therefore walks from chunk to chunk,
changing over at the first boundary shared in the overlap, and matches on alone from the last sure
boundary until one is shared where an overlap has none (a run longer than the overlap). Each piece
is then encoded by merging the adjacent pair of lowest rank, leftmost first. Decoding concatenates
the raw bytes of the ids, so it inverts the encoding for every text, also where a character is
split over ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import ddl, table, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNMERGED = 1 << 60
#: Characters before a chunk's end whose pre-tokens could change with what follows: the longest
#: fixed alternative of the pattern has three.
UNSURE = 3
CHUNK_CHARS, OVERLAP_CHARS, CACHE_PIECES, CHUNKS_AT_ONCE = 1 << 16, 1 << 10, 1 << 20, 64
IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file with one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one pre-token: merge the pair of lowest rank, leftmost first, until none is left."""
    if (rank := ranks.get(piece)) is not None:
        return (rank,)
    parts = [piece[i:i + 1] for i in range(len(piece))]
    if len(parts) > 128:
        return _merge_long(parts, ranks)
    get = ranks.get
    pairs = [get(a + b, UNMERGED) for a, b in zip(parts, parts[1:])]
    while pairs:
        lowest = min(pairs)
        if lowest == UNMERGED:
            break
        i = pairs.index(lowest)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], UNMERGED)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], UNMERGED)
    return tuple(ranks[p] for p in parts)


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same over a linked list with a heap of pairs, for runs of any length."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(parts[i] + parts[j])) is not None:
            heap.append((rank, i, len(parts[i]), len(parts[j])))

    for i in range(n):
        offer(i)
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or len(parts[i]) != left or len(parts[j]) != right:
            continue  # one of the two has been merged since
        parts[i] += parts[j]
        alive[j] = False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (i, before[i]):
            if k >= 0 and after[k] < n and (rank := ranks.get(parts[k] + parts[after[k]])) is not None:
                heapq.heappush(heap, (rank, k, len(parts[k]), len(parts[after[k]])))
    return tuple(ranks[p] for p, a in zip(parts, alive) if a)


class Encoder:
    """Encodes and decodes texts; remembers the ids of pieces, ``cache_pieces`` of them at most."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_pieces: int = CACHE_PIECES):
        self.ranks, self.find, self.cache_pieces = ranks, regex.compile(pattern), cache_pieces
        self.cache: dict[str, tuple[int, ...]] = {}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.number = {rank: str(rank) for rank in self.bytes_of}

    def pieces(self, text: str) -> list[str]:
        return self.find.findall(text)

    def ids(self, pieces: list[str]) -> list[int]:
        cache = self.cache
        for piece in set(pieces).difference(cache):
            cache[piece] = merge_piece(piece.encode(), self.ranks)
        out = list(chain.from_iterable(map(cache.__getitem__, pieces)))
        if len(cache) > self.cache_pieces:
            cache.clear()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digests(self, ids: list[int]) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal, SHA-256 of the decoded bytes."""
        decimal = ",".join(map(self.number.__getitem__, ids))
        return len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


def chunk_bounds(text: str, find, last: bool) -> list[int]:
    """Ends of the pre-tokens of a chunk that what follows the chunk cannot change."""
    ends = list(accumulate(map(len, find.findall(text))))
    while ends and not last and ends[-1] > len(text) - UNSURE:
        ends.pop()
    return ends


def stitch(text: str, chunks: list[tuple[int, list[int]]], find) -> list[str]:
    """The pre-tokens of ``text`` from (start, ends in the chunk) of overlapping chunks in order."""
    sure = [0, *(chunks[0][1] if chunks else [])]
    for start, ends in chunks[1:]:
        theirs = [start + e for e in ends]
        shared = set(theirs)
        cut = next((k for k in range(len(sure) - 1, -1, -1) if sure[k] <= start or sure[k] in shared), 0)
        if sure[cut] not in shared:
            # no shared boundary in the overlap: match on from the last sure one until there is one
            cut = len(sure) - 1
            if theirs and sure[-1] < theirs[-1]:
                for match in find.finditer(text, sure[-1]):
                    sure.append(match.end())
                    if match.end() in shared or match.end() >= theirs[-1]:
                        break
                cut = len(sure) - 1
            if sure[cut] not in shared:
                continue
        at = sure[cut]
        del sure[cut + 1:]
        sure += theirs[np.searchsorted(theirs, at, side="right"):]
    if sure[-1] < len(text):
        sure += [m.end() for m in find.finditer(text, sure[-1])]
    return [text[a:b] for a, b in zip(sure, sure[1:])]


def _whole(make: Callable[[], Encoder], row: Callable, schema: pa.Schema):
    """Texts of one chunk: pre-tokenise and encode in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or make()
            out = [row(encoder, encoder.ids(encoder.pieces(text))) for text in batch.column("text").to_pylist()]
            columns = list(zip(*out)) if out else [[]] * (len(schema) - 1)
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    return run


def _bounds(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern)
        for batch in batches:
            ends = [chunk_bounds(t, find, last) for t, last in zip(batch.column("chunk").to_pylist(), batch.column("last").to_pylist())]
            yield pa.record_batch([*(batch.column(c) for c in ("row", "doc_id", "start", "chunk")), pa.array(ends, pa.list_(pa.int32()))],
                                  names=["row", "doc_id", "start", "chunk", "ends"])

    return run


def _stitched(make: Callable[[], Encoder], row: Callable, schema: pa.Schema):
    """All chunks of one long text: stitch, then encode the pieces."""

    encoder = None  # one for all long texts of a task

    def run(group: pa.Table) -> pa.Table:
        nonlocal encoder
        encoder = encoder or make()
        chunks = sorted(zip(*(group.column(c).to_pylist() for c in ("start", "chunk", "ends"))))
        ahead = [start for start, _, _ in chunks[1:]]
        text = "".join([chunk[:after - start] for (start, chunk, _), after in zip(chunks, ahead)] + [chunks[-1][1]])
        ids = encoder.ids(stitch(text, [(start, ends) for start, _, ends in chunks], encoder.find))
        return pa.table([[group.column("doc_id")[0].as_py()], *([v] for v in row(encoder, ids))], schema=schema)

    return run


def _cut(chunk_chars: int, step: int):
    """Long texts in, their overlapping chunks out, a row each, of a few texts' worth at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                starts = range(0, len(text) - (chunk_chars - step), step)
                for some in (starts[i:i + CHUNKS_AT_ONCE] for i in range(0, len(starts), CHUNKS_AT_ONCE)):
                    yield pa.record_batch([pa.array([row] * len(some), pa.int64()), pa.array([doc_id] * len(some), pa.int64()), pa.array(some, pa.int64()),
                                           pa.array([text[s:s + chunk_chars] for s in some], pa.string()),
                                           pa.array([s + chunk_chars >= len(text) for s in some], pa.bool_())],
                                          names=["row", "doc_id", "start", "chunk", "last"])

    return run


def _encoded(docs: DataFrame, ranks_path: str, pattern: str, row: Callable, schema: pa.Schema, id_col: str, text_col: str,
             chunk_chars: int, overlap_chars: int) -> DataFrame:
    if overlap_chars >= chunk_chars:
        raise ValueError("the overlap must be shorter than the chunk")

    def make() -> Encoder:
        return Encoder(load_ranks(ranks_path), pattern)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    length, step = F.length("text"), chunk_chars - overlap_chars
    short = rows.filter(length <= chunk_chars).mapInArrow(_whole(make, row, schema), ddl(schema))
    chunks = (rows.filter(length > chunk_chars).withColumn("row", F.monotonically_increasing_id())
              .mapInArrow(_cut(chunk_chars, step), "row bigint, doc_id bigint, start bigint, chunk string, last boolean")
              .repartition("row", "start"))
    bounds = chunks.mapInArrow(_bounds(pattern), "row bigint, doc_id bigint, start bigint, chunk string, ends array<int>")
    return short.unionByName(bounds.groupBy("row").applyInArrow(_stitched(make, row, schema), ddl(schema)))


def encode(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text",
           chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """(doc_id, ids): the BPE ids of each row's whole text, without special tokens.

    One row per input row, in any order; repeated rows are encoded each, a null or empty text has
    no ids, a null id is kept, an empty table gives none. ``ranks_path`` must be readable where tasks
    run. No text is cut: those above ``chunk_chars`` are chunked and stitched.
    """
    return _encoded(docs, ranks_path, pattern, lambda _, ids: (ids,), IDS, id_col, text_col, chunk_chars, overlap_chars)


def decode(ids: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded): the raw bytes of the ids, concatenated. Null ids decode to no bytes; an
    unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load_ranks(ranks_path), r"\w")
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array([encoder.decode(x or []) for x in batch.column("ids").to_pylist()], pa.binary())],
                                  names=["doc_id", "decoded"])

    return (ids.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
            .mapInArrow(run, "doc_id bigint, decoded binary"))


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id",
                       text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Encode and decode each text and return digests of both, so that no id leaves its task:
    (doc_id, n_tokens, ids_sha256, decoded_sha256). Rows and edge cases as in :func:`encode`."""
    return _encoded(docs, ranks_path, pattern, lambda e, ids: e.digests(ids), DIGESTS, id_col, text_col, chunk_chars, overlap_chars)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the multilingual ranks, and decoded again."""
    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
