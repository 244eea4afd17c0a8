"""Removal of repeated byte strings by hash-compared suffix sorting.

A byte goes if a string of ``length`` bytes that covers it also starts earlier. The strings are the
windows of a sparse suffix array that Spark deals by content:

1. **Anchors.** Every window of ``length`` bytes picks the ``gram``-byte string in it whose hash is
   least, so equal windows pick the same one at the same place. A run of windows with one anchor is
   one record: the anchor's hash, a 96-bit digest of the bytes that the run spans, and where it is.
   Hashes come from prefix polynomial hashes, one running sum a text.
2. **Equal runs.** Records are shuffled by anchor, packed as columns of bytes. Of equal runs all but
   the earliest are repeats; tasks settle those they see themselves before the shuffle, so a copy that
   a third of the documents share is a record a task.
3. **Suffix sort.** Where runs with one anchor differ, as at the ends of a passage, their bytes are
   fetched and their windows are suffixes that start at one distance from the anchor. A merge sort
   orders them; a comparison finds the common extension of two suffixes by binary search over
   prefix hashes. Neighbours in that order whose extension reaches ``length`` are equal, which is
   verified byte by byte; all but the earliest of them are repeats.
   An anchor with more than ``hot_runs`` different runs is not sorted, since its runs grow with the
   documents: each of their windows is a record, dealt by a 96-bit digest of its bytes beside the hash
   of its ``long_gram``-byte anchor, so that only equal windows meet. They are settled like equal runs,
   first in each group of documents, which a passage leaves as one record a window.
4. **Removal.** The repeats of each document are joined to it, united and cut out.
"""

from __future__ import annotations

import hashlib
import struct
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import release_shuffles, table, text_of, written
from tidepool.session import default_partitions, scratch_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH, GRAM, LONG_GRAM, HOT_RUNS = 100, 24, 88, 256
FLUSH_RECORDS, GROUP_BYTES, BLOCK_STARTS, SORT_WINDOWS = 1 << 18, 8 << 20, 1 << 20, 1 << 18
POSITION_BITS = 24
LOWEST = -(1 << 63)
BASE = 0x9E3779B97F4A7C15
#: Columns of packed rows: name and type.
MARK = (("doc", "<i8"), ("tie", "<i8"), ("lo", "<u4"), ("hi", "<u4"))
RUN = (("anchor", "<u8"), ("digest", "<u8"), ("digest2", "<u4"), ("doc", "<i8"), ("tie", "<i8"), ("lo", "<u4"), ("back", "u1"), ("last", "u1"))
REQUEST = (("anchor", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("lo", "<u4"), ("back", "u1"), ("last", "u1"), ("hot", "u1"))
FRAGMENT = (("anchor", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("lo", "<u4"), ("back", "u1"), ("last", "u1"))
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as are asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            self.up, self.down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, dtype=np.uint64)])
                                  for b in (BASE, pow(BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


def prefix_hashes(codes: np.ndarray, powers: Powers) -> np.ndarray:
    """sums[i] over the first i bytes; (sums[i + n] - sums[i]) * base^i is the hash of n bytes at i."""
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(len(codes))[1], out=sums[1:])
    return sums


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchored_runs(raw: bytes, powers: Powers, length: int, gram: int, block: int = BLOCK_STARTS) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, anchor position, first start, last start, polynomial hash of the span) of the runs
    of windows, block by block of starts; a run that a block cuts is two runs."""
    w = length - gram + 1
    for at in range(0, len(raw) - length + 1, block):
        codes = np.frombuffer(raw, dtype=np.uint8, count=min(len(raw) - at, block + length - 1), offset=at)
        sums, up = prefix_hashes(codes, powers), powers(len(codes))[0]
        h = _mixed((sums[gram:] - sums[:-gram]) * up[:len(codes) - gram + 1])
        # the least hash in each window, leftmost first: the low bits hold the position
        least = (h >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= w:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        if width < w:
            least = np.minimum(least[:width - w], least[w - width:])
        lo = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        hi = np.r_[lo[1:], len(least)] - 1
        x = (least[lo] & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
        yield h[x], x + at, lo + at, hi + at, (sums[hi + length] - sums[lo]) * up[lo]


def pack(columns: dict[str, np.ndarray], kinds) -> dict[str, bytes]:
    """Each column as planes of bytes, highest first, so that small numbers compress to little."""
    out = {}
    for name, kind in kinds:
        a = np.ascontiguousarray(columns[name], dtype=kind)
        out[name] = a.view(np.uint8).reshape(len(a), -1).T.tobytes()
    return out


def unpack(rows: dict[str, list[bytes]], kinds) -> dict[str, np.ndarray]:
    out = {}
    for name, kind in kinds:
        size = np.dtype(kind).itemsize
        parts = [np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel() for b in rows[name]]
        out[name] = np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
    return out


def _take(columns: dict[str, np.ndarray], at) -> dict[str, np.ndarray]:
    return {name: a[at] for name, a in columns.items()}


def _joined(parts: list[dict[str, np.ndarray]], kinds) -> dict[str, np.ndarray]:
    return {name: np.concatenate([p[name] for p in parts] or [np.zeros(0, dtype=kind)]) for name, kind in kinds}


def _ranked(columns: dict[str, np.ndarray]) -> np.ndarray:
    """Rank of each row's document in the order of (doc, tie)."""
    order = np.lexsort((columns["tie"], columns["doc"]))
    doc, tie = columns["doc"][order], columns["tie"][order]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(np.r_[False, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])]) if len(order) else 0
    return rank


def settle_runs(runs: dict[str, np.ndarray], length: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(the earliest of each set of equal runs, sorted by anchor; marks of all the others)."""
    place = (_ranked(runs).astype(np.uint64) << np.uint64(32)) | runs["lo"].astype(np.uint64)
    order = np.lexsort((place, runs["back"], runs["last"], runs["digest2"], runs["digest"], runs["anchor"]))
    runs = _take(runs, order)
    first = np.ones(len(order), dtype=bool)
    if len(order):
        first[1:] = np.any([runs[c][1:] != runs[c][:-1] for c in ("anchor", "digest", "digest2", "last", "back")], axis=0)
    return _take(runs, first), coalesced(_marks(_take(runs, ~first)), length)


def _marks(runs: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Every window of these runs is a repeat."""
    return {"doc": runs["doc"], "tie": runs["tie"], "lo": runs["lo"], "hi": runs["lo"] + runs["last"]}


def coalesced(marks: dict[str, np.ndarray], length: int) -> dict[str, np.ndarray]:
    """The same bytes in fewer marks: those of one document that touch are one."""
    if not len(marks["doc"]):
        return marks
    rank = _ranked(marks)
    order = np.lexsort((marks["lo"], rank))
    marks, rank = _take(marks, order), rank[order]
    # offset the documents, so that one running maximum serves them all
    shift = rank * (1 << 33)
    lo, reach = marks["lo"] + shift, np.maximum.accumulate(marks["hi"] + shift + length)
    head = np.r_[True, lo[1:] > reach[:-1]]
    out = _take(marks, head)
    out["hi"] = (reach[np.r_[head[1:], True]] - length - shift[head]).astype("<u4")
    return out


def doc_bucket(doc: np.ndarray, tie: np.ndarray, n: int) -> np.ndarray:
    """``pmod(xxhash64(doc_id, tie), n)`` as Spark has it: chained XXH64 of the eight bytes."""
    if not len(doc):
        return np.zeros(0, dtype=np.int64)
    rank = _ranked({"doc": doc, "tie": tie})
    _, at, back = np.unique(rank, return_index=True, return_inverse=True)
    h = [xxhash.xxh64_intdigest(struct.pack("<q", t), xxhash.xxh64_intdigest(struct.pack("<q", d), 42))
         for d, t in zip(doc[at].tolist(), tie[at].tolist())]
    return (np.array(h, dtype=np.uint64).view(np.int64) % n)[back]


def _by_bucket(bucket: np.ndarray, n_rows: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]]) if n_rows else []
    for a, b in zip(cuts, [*cuts[1:], n_rows]):
        yield int(bucket[order[a]]), order[a:b]


def _rows_of(parts: list[tuple[str, dict, tuple]], schema: pa.Schema, extra: dict | None = None) -> Iterator[pa.RecordBatch]:
    """One packed row for each bucket; ``parts``: (prefix, columns, bucket of each row)."""
    rows: dict[int, dict] = {}
    for prefix, columns, kinds, bucket in parts:
        for b, at in _by_bucket(bucket, len(bucket)):
            rows.setdefault(b, {}).update({prefix + k: v for k, v in pack(_take(columns, at), kinds).items()})
            if extra is not None and prefix == extra["prefix"]:
                rows[b][extra["name"]] = b"".join(extra["values"][i] for i in at.tolist())
    listed = list(rows.items())
    for at in range(0, len(listed), 64):
        chunk = listed[at:at + 64]
        yield pa.record_batch([pa.array([b for b, _ in chunk], pa.int64()), *(pa.array([r.get(f.name, b"") for _, r in chunk], pa.binary())
                                                                              for f in list(schema)[1:])], schema=schema)


def _schema(*kinds, extra: tuple[str, ...] = ()) -> pa.Schema:
    return pa.schema([("bucket", pa.int64()), *((p + name, pa.binary()) for p, columns in kinds for name, _ in columns), *((e, pa.binary()) for e in extra)])


def _sql_type(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'binary'}" for f in schema)


RUN_ROWS = _schema(("r_", RUN), ("m_", MARK))
SETTLED_ROWS = _schema(("q_", REQUEST), ("m_", MARK))
FRAGMENT_ROWS = _schema(("f_", FRAGMENT), ("w_", RUN), ("m_", MARK), extra=("f_bytes",))
MARK_ROWS = _schema(("m_", MARK))


def _anchors(length: int, gram: int, flush: int, n_buckets: int):
    """Texts in, packed runs out; equal runs within a task are settled here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, parts, held = Powers(), [], 0

        def rows():
            runs, marks = settle_runs(_joined(parts, RUN), length)
            bucket = (runs["anchor"] % np.uint64(n_buckets)).astype(np.int64)
            # repeats settled here only travel along, evenly dealt
            spread = (_mixed(marks["doc"].astype(np.uint64) * np.uint64(BASE) + marks["lo"]) % np.uint64(n_buckets)).astype(np.int64)
            return _rows_of([("r_", runs, RUN, bucket), ("m_", marks, MARK, spread)], RUN_ROWS)

        for batch in batches:
            for doc, tie, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tie", "text"))):
                raw = text.encode()
                if len(raw) < length:
                    continue
                for anchor, x, lo, hi, poly in anchored_runs(raw, powers, length, gram):
                    digest = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist())]
                    parts.append({"anchor": anchor, "digest": np.array(digest, dtype=np.uint64), "digest2": (_mixed(poly) >> np.uint64(32)).astype("<u4"),
                                  "doc": np.full(len(lo), doc, dtype=np.int64), "tie": np.full(len(lo), tie, dtype=np.int64), "lo": lo.astype("<u4"),
                                  "back": (x - lo).astype("u1"), "last": (hi - lo).astype("u1")})
                    held += len(lo)
                if held >= flush:
                    yield from rows()
                    parts, held = [], 0
        if parts:
            yield from rows()

    return run


def _read(batches: Iterator[pa.RecordBatch], *kinds) -> list[dict[str, np.ndarray]]:
    held: dict[str, list[bytes]] = {p + name: [] for p, columns in kinds for name, _ in columns}
    for batch in batches:
        for name, values in held.items():
            values += batch.column(name).to_pylist()
    return [unpack({name: held[p + name] for name, _ in columns}, columns) for p, columns in kinds]


def _settle(length: int, n_docs: int, hot_runs: int):
    """Packed runs of some anchors in; marks, and requests for the bytes of runs that differ, out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, marks = _read(batches, ("r_", RUN), ("m_", MARK))
        runs, more = settle_runs(runs, length)
        marks = coalesced(_joined([marks, more], MARK), length)
        anchor = runs["anchor"]
        _, group, size = np.unique(anchor, return_inverse=True, return_counts=True)
        size = size[group] if len(anchor) else np.zeros(0, dtype=np.int64)
        asked = _take(runs | {"hot": (size > hot_runs).astype("u1")}, size > 1)
        yield from _rows_of([("q_", asked, REQUEST, doc_bucket(asked["doc"], asked["tie"], n_docs)),
                                     ("m_", marks, MARK, doc_bucket(marks["doc"], marks["tie"], n_docs))], SETTLED_ROWS)

    return run


def _windows(piece: bytes, doc: int, tie: int, lo: int, length: int, long_gram: int, powers: Powers) -> dict[str, np.ndarray]:
    """Each window of a piece as a run of its own, under the ``long_gram``-byte anchor that it picks."""
    anchor, x, first, last = (np.concatenate(c) for c in list(zip(*anchored_runs(piece, powers, length, long_gram)))[:4])
    of, step = np.repeat(np.arange(len(anchor)), last - first + 1), np.arange(len(piece) - length + 1)
    digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(piece[a:a + length]) for a in range(len(step))), dtype="<u8").reshape(-1, 2)
    return {"anchor": anchor[of], "digest": digest[:, 0], "digest2": (digest[:, 1] >> np.uint64(32)).astype("<u4"), "doc": np.full(len(step), doc, dtype=np.int64),
            "tie": np.full(len(step), tie, dtype=np.int64), "lo": (lo + step).astype("<u4"), "back": (x[of] - step).astype("u1"), "last": np.zeros(len(step), dtype="u1")}


def _fetch(length: int, long_gram: int, n_buckets: int, flush: int = FLUSH_RECORDS):
    """Documents and requests of one bucket in; packed runs with their bytes, and windows of hot anchors, out."""

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        if not docs.num_rows or not asked.num_rows:
            return FRAGMENT_ROWS.empty_table()
        (requests,), powers = _read(asked.to_batches(), ("q_", REQUEST)), Powers()
        texts = {(d, t): raw.encode() for d, t, raw in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "tie", "text")))}
        out, pieces, batches, parts, held = [], [], [], [], 0

        # a bucket a task: every group of documents fills all of them, so eight times as many only make more rows
        n_coarse = np.uint64(max(1, n_buckets // 8))

        def settled() -> list[tuple]:
            windows, marks = settle_runs(_joined(parts, RUN), length)
            bucket = (_mixed(windows["digest"] ^ windows["anchor"]) % n_coarse).astype(np.int64)
            spread = (_mixed(marks["doc"].astype(np.uint64) * np.uint64(BASE) + marks["lo"]) % n_coarse).astype(np.int64)
            return [("w_", windows, RUN, bucket), ("m_", marks, MARK, spread)]

        for anchor, doc, tie, lo, back, last, hot in zip(*(requests[c].tolist() for c, _ in REQUEST)):
            piece = texts[doc, tie][lo:lo + last + length]
            if not hot:
                out.append((anchor, doc, tie, lo, back, last))
                pieces.append(piece)
                continue
            parts.append(_windows(piece, doc, tie, lo, length, long_gram, powers))
            held += last + 1
            if held >= flush:
                batches += _rows_of(settled(), FRAGMENT_ROWS)
                parts, held = [], 0
        columns = {name: np.array(c, dtype=kind) for (name, kind), c in zip(FRAGMENT, zip(*out) if out else [[]] * len(FRAGMENT))}
        bucket = (columns["anchor"] % np.uint64(n_buckets)).astype(np.int64)
        batches += _rows_of([("f_", columns, FRAGMENT, bucket), *settled()], FRAGMENT_ROWS, {"prefix": "f_", "name": "f_bytes", "values": pieces})
        return pa.Table.from_batches(batches, schema=FRAGMENT_ROWS)

    return run


class Suffixes:
    """Windows of ``length`` bytes over one buffer, compared by their prefix hashes."""

    def __init__(self, buffer: bytes, offsets: np.ndarray, length: int, powers: Powers):
        self.codes, self.offsets, self.length = np.frombuffer(buffer, dtype=np.uint8), offsets, length
        self.sums, self.power = prefix_hashes(self.codes, powers), powers(len(self.codes) + 1)[0]
        self.before, self.scale = self.sums[offsets], self.power[offsets]
        self.whole = self._hash(np.arange(len(offsets)), length)

    def _hash(self, e: np.ndarray, n) -> np.ndarray:
        return (self.sums[self.offsets[e] + n] - self.before[e]) * self.scale[e]

    def extension(self, e: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Length of the common prefix of each pair, by binary search over the hashes."""
        known, limit = np.zeros(len(e), dtype=np.int64), np.full(len(e), self.length, dtype=np.int64)
        same = self.whole[e] == self.whole[f]
        known[same] = self.length
        left = np.flatnonzero(~same)
        limit[left] -= 1
        while len(left):
            middle = (known[left] + limit[left] + 1) // 2
            equal = self._hash(e[left], middle) == self._hash(f[left], middle)
            known[left[equal]] = middle[equal]
            limit[left[~equal]] = middle[~equal] - 1
            left = left[known[left] < limit[left]]
        return known

    def less(self, e: np.ndarray, f: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix e comes before f; for equal ones, ``or_equal``."""
        n = self.extension(e, f)
        out, differ = or_equal.copy(), n < self.length
        e, f, n = e[differ], f[differ], n[differ]
        out[differ] = self.codes[self.offsets[e] + n] < self.codes[self.offsets[f] + n]
        return out

    def equal(self, e: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Verification: whether the bytes of each pair are the same."""
        out, span = np.empty(len(e), dtype=bool), np.arange(self.length)
        for at in range(0, len(e), 1 << 14):
            a, b = self.offsets[e[at:at + (1 << 14)], None] + span, self.offsets[f[at:at + (1 << 14)], None] + span
            out[at:at + (1 << 14)] = (self.codes[a] == self.codes[b]).all(axis=1)
        return out


def merge_sort(suffixes: Suffixes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The suffixes in order within their groups; group g holds the places start..end of each place.

    Bottom-up: runs of 1, 2, 4, ... are merged pairwise, all pairs of all groups at once. A suffix's
    place in the merged run is its place in its own run plus its rank in the other, found by binary
    search; equal suffixes keep their order.
    """
    order, run = np.arange(len(start)), 1
    while len(at := np.flatnonzero(end - start > run)):
        local, first, stop = at - start[at], start[at], end[at]
        a0 = first + local // (2 * run) * 2 * run
        b0, b1 = np.minimum(a0 + run, stop), np.minimum(a0 + 2 * run, stop)
        left = at < b0
        low, high = np.where(left, b0, a0), np.where(left, b1, b0)
        base, own = low.copy(), order[at]
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo]) // 2
            # a suffix of the left run goes before equal ones of the right run, not the other way round
            right = suffixes.less(order[middle], own[todo], ~left[todo])
            low[todo[right]] = middle[right] + 1
            high[todo[~right]] = middle[~right]
            todo = todo[low[todo] < high[todo]]
        rank = low - base
        merged = order.copy()
        merged[np.where(left, at + rank, a0 + (at - b0) + rank)] = own
        order, run = merged, 2 * run
    return order


def repeated_windows(buffer: bytes, offsets: np.ndarray, group: np.ndarray, place: np.ndarray, length: int, powers: Powers) -> np.ndarray:
    """Which windows (at ``offsets`` in the buffer) equal one of their group with a smaller ``place``."""
    by_group = np.argsort(group, kind="stable")
    g = group[by_group]
    cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    sizes = np.diff(np.r_[cut, len(g)])
    start, end = np.repeat(cut, sizes), np.repeat(cut + sizes, sizes)
    suffixes = Suffixes(buffer, offsets[by_group], length, powers)
    order = merge_sort(suffixes, start, end)
    inside = np.flatnonzero(start[1:] == start[:-1]) + 1
    e, f = order[inside - 1], order[inside]
    claimed = suffixes.extension(e, f) >= length
    true = suffixes.equal(e[claimed], f[claimed])
    same = np.zeros(len(order), dtype=bool)
    same[inside[claimed]] = true
    if not true.all():  # the hashes collided: compare the bytes of all windows of those groups instead
        return _repeated_by_bytes(buffer, offsets, group, place, length)
    heads = np.flatnonzero(~same)
    least = np.minimum.reduceat(place[by_group][order], heads) if len(heads) else np.zeros(0, dtype=np.int64)
    out = np.zeros(len(order), dtype=bool)
    out[by_group[order]] = place[by_group][order] > np.repeat(least, np.diff(np.r_[heads, len(order)]))
    return out


def _repeated_by_bytes(buffer: bytes, offsets: np.ndarray, group: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    least: dict[tuple[int, bytes], int] = {}
    keys = [(g, buffer[o:o + length]) for g, o in zip(group.tolist(), offsets.tolist())]
    for key, p in zip(keys, place.tolist()):
        least[key] = min(p, least.get(key, p))
    return np.array([p > least[key] for key, p in zip(keys, place.tolist())], dtype=bool)


def _sort_runs(length: int, n_docs: int, sort_windows: int):
    """Packed runs with their bytes and windows of hot anchors in, marks of repeated windows out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held = Powers(), {f.name: [] for f in list(FRAGMENT_ROWS)[1:]}
        for batch in batches:
            for name, values in held.items():
                values += batch.column(name).to_pylist()
        hot = settle_runs(unpack({name: held.pop(f"w_{name}") for name, _ in RUN}, RUN), length)[1]
        done_before = unpack({name: held.pop(f"m_{name}") for name, _ in MARK}, MARK)
        runs = unpack({name: held[f"f_{name}"] for name, _ in FRAGMENT}, FRAGMENT)
        data, size = b"".join(held.pop("f_bytes")), runs["last"].astype(np.int64) + length
        starts = np.cumsum(size) - size
        place = (_ranked(runs) << 32) | runs["lo"].astype(np.int64)
        keep, marks = _collapse(data, runs, starts, size, place)
        marks += [hot, done_before]
        order = keep[np.lexsort((place[keep], runs["anchor"][keep]))]
        anchor, windows = runs["anchor"][order], np.cumsum(runs["last"][order].astype(np.int64) + 1)
        cuts = np.r_[np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]), len(order)] if len(order) else np.zeros(1, dtype=np.int64)
        at = 0
        while at < len(cuts) - 1:  # some whole anchors at a time
            done = windows[cuts[at] - 1] if cuts[at] else 0
            stop = max(at + 1, int(np.searchsorted(windows[cuts[1:] - 1], done + sort_windows, side="right")))
            marks.append(_sort_some(data, _take(runs, order[cuts[at]:cuts[stop]]), starts[order[cuts[at]:cuts[stop]]], place[order[cuts[at]:cuts[stop]]], length, powers))
            at = stop
        marks = coalesced(_joined(marks, MARK), length)
        yield from _rows_of([("m_", marks, MARK, doc_bucket(marks["doc"], marks["tie"], n_docs))], MARK_ROWS)

    return run


def _collapse(data: bytes, runs, starts, size, place) -> tuple[np.ndarray, list[dict]]:
    """The earliest of each set of runs with the same bytes, and the marks of the others."""
    first: dict[tuple, int] = {}
    again = []
    for i, key in enumerate(zip(runs["anchor"].tolist(), runs["back"].tolist(), (data[a:a + n] for a, n in zip(starts.tolist(), size.tolist())))):
        j = first.setdefault(key, i)
        if j != i:
            if place[i] < place[j]:
                first[key], i = i, j
            again.append(i)
    return np.array(sorted(first.values()), dtype=np.int64), [_marks(_take(runs, np.array(again, dtype=np.int64)))]


def _sort_some(data: bytes, runs: dict[str, np.ndarray], starts: np.ndarray, place: np.ndarray, length: int, powers: Powers) -> dict[str, np.ndarray]:
    n, n_runs = runs["last"].astype(np.int64) + 1, len(starts)
    buffer = b"".join(data[a:a + m + length - 1] for a, m in zip(starts.tolist(), n.tolist()))
    fragment = np.cumsum(n + length - 1) - (n + length - 1)
    of = np.repeat(np.arange(n_runs), n)
    step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    _, anchor = np.unique(runs["anchor"], return_inverse=True)
    group = anchor[of] * 256 + (runs["back"].astype(np.int64)[of] - step)  # windows at one distance from one anchor
    again = repeated_windows(buffer, fragment[of] + step, group, place[of] + step, length, powers)
    # runs of repeated windows in one fragment
    at = np.flatnonzero(again)
    if not len(at):
        return _joined([], MARK)
    head = np.r_[True, (np.diff(at) != 1) | (of[at][1:] != of[at][:-1])]
    first, last = at[head], at[np.r_[head[1:], True]]
    lo = runs["lo"][of[first]].astype(np.int64)
    return {"doc": runs["doc"][of[first]], "tie": runs["tie"][of[first]], "lo": (lo + step[first]).astype("<u4"), "hi": (lo + step[last]).astype("<u4")}


def united(lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of bytes that windows starting at lo..hi cover, as (start, end)."""
    order = np.argsort(lo, kind="stable")
    start, reach = lo[order].astype(np.int64), np.maximum.accumulate(hi[order].astype(np.int64) + length)
    head = np.r_[True, start[1:] > reach[:-1]]
    return start[head], reach[np.r_[head[1:], True]]


def _remove(length: int, with_kept: bool):
    """Documents and marks of one bucket in, a result row per document out."""

    def run(docs: pa.Table, marked: pa.Table) -> pa.Table:
        (marks,) = _read(marked.to_batches(), ("m_", MARK))
        order = np.lexsort((marks["tie"], marks["doc"]))
        marks = _take(marks, order)
        ends = np.flatnonzero(np.r_[(marks["doc"][1:] != marks["doc"][:-1]) | (marks["tie"][1:] != marks["tie"][:-1]), True]) + 1 if len(order) else []
        of = {(int(marks["doc"][b - 1]), int(marks["tie"][b - 1])): (a, b) for a, b in zip([0, *ends[:-1]], ends)}
        out = []
        for doc, tie, text in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "tie", "text"))):
            raw, n_removed, n_spans = text.encode(), 0, 0
            kept = raw
            if (doc, tie) in of:
                a, b = of[doc, tie]
                start, end = united(marks["lo"][a:b], marks["hi"][a:b], length)
                n_removed, n_spans = int((end - start).sum()), len(start)
                kept = b"".join(raw[x:y] for x, y in zip([0, *end.tolist()], [*start.tolist(), len(raw)]))
            out.append((None if doc == LOWEST else doc, len(raw), n_removed, n_spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], names=names)

    return run


def _identified(docs: DataFrame, id_col: str, text_col: str, folder: str) -> DataFrame:
    """(doc_id, tie, text): ``tie`` tells rows apart that share an id. It is zero where ids are unique;
    else the rows are numbered and stored, so that every later pass sees the same numbers."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LOWEST)).alias("doc_id"), text_of(text_col).alias("text"))
    if rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return rows.select("doc_id", F.lit(0).cast("bigint").alias("tie"), "text")
    return written(rows.select("doc_id", F.monotonically_increasing_id().alias("tie"), "text"), folder, "numbered")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                   long_gram: int = LONG_GRAM, hot_runs: int = HOT_RUNS, flush_records: int = FLUSH_RECORDS, group_bytes: int = GROUP_BYTES,
                   sort_windows: int = SORT_WINDOWS, with_kept: bool = True) -> DataFrame:
    """Every row's text, as UTF-8, without the bytes that repeated strings of ``length`` bytes cover.

    (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): ``n_spans`` counts the maximal removed
    runs; ``kept`` holds the remaining bytes, null without ``with_kept``. A string repeats if it also
    starts earlier, in a document with a smaller id or before in the same document; matches never
    cross documents and all strings are those of the input. A null text is empty; a null id sorts
    below all others; rows that share an id count in the order in which they are read. Texts below
    ``length`` bytes stay whole. An empty table gives no rows.
    """
    if not 0 < gram < long_gram <= length <= 255:
        raise ValueError("need 0 < gram < long_gram <= length <= 255")
    spark, folder = docs.sparkSession, scratch_folder(docs.sparkSession)
    rows = _identified(docs, id_col, text_col, folder)
    total = int(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    # about 3 % of the bytes are anchors of some 26 bytes: tasks of 8 MB, split into eight buckets each
    tasks = max(default_partitions(spark), total // (8 << 20))
    n_buckets, n_docs = 8 * tasks, max(2 * default_partitions(spark), -(-total // group_bytes))
    runs = rows.mapInArrow(_anchors(length, gram, flush_records, n_buckets), _sql_type(RUN_ROWS))
    settled = written(runs.repartition(tasks, "bucket").mapInArrow(_settle(length, n_docs, hot_runs), _sql_type(SETTLED_ROWS)), folder, "settled")
    release_shuffles(spark)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(n_docs)))
    asked = settled.select("bucket", *(f"q_{name}" for name, _ in REQUEST)).filter(F.octet_length("q_lo") > 0)
    fragments = dealt.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_fetch(length, long_gram, n_buckets, flush_records), _sql_type(FRAGMENT_ROWS))
    marks = written(fragments.repartition(tasks, "bucket").mapInArrow(_sort_runs(length, n_docs, sort_windows), _sql_type(MARK_ROWS)), folder, "marks")
    release_shuffles(spark)
    names = ["bucket", *(f"m_{name}" for name, _ in MARK)]
    marked = settled.select(*names).unionByName(marks.select(*names)).filter(F.octet_length("m_lo") > 0)
    return dealt.groupBy("bucket").cogroup(marked.groupBy("bucket")).applyInArrow(_remove(length, with_kept), RESULT)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated strings of 100 bytes."""
    return remove_repeats(table(spark, sf_dir, "documents"), with_kept=False).drop("kept")
