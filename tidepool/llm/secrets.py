"""Secret scan: fixed patterns plus the guess cost of values in a credential context.

The base patterns find assignments, access keys and long hex runs. The method adds values that
stand in a credential context (``pwd = ...``, ``auth: ...``) and are hard to guess: a dynamic
programme finds the cheapest segmentation of the value into dictionary words, dates, repeats,
keyboard walks and brute-force spans, in bits, and a value whose cheapest explanation is still dear
is a secret; one that is made of words, dates and walks is a placeholder. Words that are not in the
short list are priced by the letters of the corpus itself: how often each letter follows the two
before it in all documents, a table of fixed size however large the corpus is.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import ddl, table, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# for these two a run's length decides, so the bound can stand in the pattern
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|login|private_?key|access_?key|api_?key)"""
                     r"""["']?\x20*(?:=>|:=|[:=])\x20*["']?([^\s"'<>`]+)""", re.I | re.A)
#: Words that passwords and placeholders are made of; the place in the list is the rank. Fixed values.
WORDS = """password admin user test secret token changeme example letmein welcome login master root default guest
dragon monkey football baseball sunshine princess shadow superman michael jordan hunter killer soccer hockey
ranger daniel andrew thomas charlie summer winter spring autumn monday friday january december october hello
love money access server database system public private demo sample dummy your here none null true false
please enter insert value string redacted hidden placeholder company office london paris berlin the and for
you are with this that from have not what all can iloveyou trustno""".split()
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "qazwsxedcrfvtgbyhnujmikolp", "!@#$%^&*()")
LEET = str.maketrans("4@831|05$7+", "aabeiiosstt")
SEGMENT_BITS = 1.0  # for saying where the next segment starts and of which kind it is
GUESS_BITS = 48.0
MIN_VALUE = 8
TRIPLES = 27 ** 3
COUNTED_BYTES = 1 << 20  # at a time, so that a task's arrays stay small
LETTERS = np.zeros(256, dtype=np.uint16)
LETTERS[97:123] = LETTERS[65:91] = np.arange(1, 27)
REPEAT_UNIT = 8
SPANS = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                   ("base_sha256", pa.string()), ("spans", pa.string()), ("n_guess", pa.int64()), ("max_guess_bits", pa.float64())])


def char_bits(value: str) -> float:
    """Bits of one brute-force character of a value: the alphabets of all classes that it uses."""
    size = 10 * any("0" <= c <= "9" for c in value) + 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value)
    size += 33 * any(c.isascii() and not c.isalnum() for c in value) + (1 << 12) * (not value.isascii())
    return math.log2(max(2, size))


def letter_triples(raw: bytes) -> np.ndarray:
    """The numbers of all triples of bytes, each 1 to 26 for a letter of either case and 0 for any other."""
    codes = LETTERS[np.frombuffer(raw, dtype=np.uint8)]
    return (codes[:-2] * 27 + codes[1:-1]) * 27 + codes[2:]


def count_letters(texts: DataFrame) -> np.ndarray:
    """How often each triple of letters (or other) stands in all the texts: 27 to the third counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TRIPLES, dtype=np.int64)
        for batch in batches:
            raw = "  ".join(["", *batch.column("text").to_pylist(), ""]).encode()
            for at in range(0, len(raw) - 2, COUNTED_BYTES):
                total += np.bincount(letter_triples(raw[at:at + COUNTED_BYTES + 2]), minlength=TRIPLES)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["triple", "n"])

    counts = np.zeros(TRIPLES, dtype=np.int64)
    for r in texts.mapInArrow(run, "triple bigint, n bigint").groupBy("triple").agg(F.sum("n").alias("n")).collect():
        counts[r["triple"]] = r["n"]
    return counts


def letter_bits(counts: np.ndarray) -> np.ndarray:
    """Bits of each letter after the two before it, smoothed by half a count."""
    n = counts.reshape(-1, 27) + 0.5
    return (np.log2(n.sum(axis=1, keepdims=True)) - np.log2(n)).ravel()


def _word_ranks() -> dict[str, float]:
    return {w: math.log2(rank + 2) for rank, w in enumerate(WORDS)}


def _walk_steps() -> set[tuple[str, str]]:
    """Neighbouring keys, in either direction."""
    steps = {(a, b) for row in WALKS for a, b in zip(row, row[1:])}
    return steps | {(b, a) for a, b in steps}


def _date_bits(s: str) -> float | None:
    """Bits of a date: 4 to 8 digits, or three numbers with one separator twice."""
    m = re.fullmatch(r"(\d{1,4})([-/._])(\d{1,2})\2(\d{1,4})", s, re.A)
    if m:
        parts = (m[1], m[3], m[4])
    elif re.fullmatch(r"\d{4}", s, re.A):
        return math.log2(150) if 1900 <= int(s) <= 2049 else None
    elif re.fullmatch(r"\d{6}", s, re.A):
        parts = (s[:2], s[2:4], s[4:])
    elif re.fullmatch(r"\d{8}", s, re.A):
        parts = (s[:4], s[4:6], s[6:]) if 1900 <= int(s[:4]) <= 2049 else (s[:2], s[2:4], s[4:])
    else:
        return None
    a, b, c = map(int, parts)
    year = max(a, c) if max(len(parts[0]), len(parts[2])) == 4 else 2000
    day_month = sorted(x for x in ((b, c) if len(parts[0]) == 4 else (a, b)))
    if not (1900 <= year <= 2049 and 1 <= day_month[0] <= 12 and 1 <= day_month[1] <= 31):
        return None
    return math.log2(366 * 150) + (2 if m else 0)


class GuessCost:
    """Minimum-cost segmentation of a value, in bits; linear in its length, as every kind of
    segment but the brute-force span has a bounded length or is found by its run. ``letters`` are the
    bits of letter triples (:func:`letter_bits`); without them only listed words are words."""

    def __init__(self, letters: np.ndarray | None = None) -> None:
        self.letters = letters
        self.words, self.steps = _word_ranks(), _walk_steps()
        self.longest = max(map(len, self.words))

    def _segments(self, value: str) -> dict[int, list[tuple[int, float, str]]]:
        """By end: (start, bits, kind) of words, dates, walks, repeats and runs of letters in one case."""
        found: dict[int, list[tuple[int, float, str]]] = {}
        low, n, char = value.lower(), len(value), char_bits(value)
        plain = low.translate(LEET) if len(low) == n else low
        if len(low) != n:  # a character whose lower case is longer: leave the case as it is
            low = plain = value
        add = lambda a, b, bits, kind: found.setdefault(b, []).append((a, bits, kind))
        for a in range(n):
            for b in range(a + 3, min(n, a + self.longest) + 1):
                rank = self.words.get(low[a:b])
                leet = 0.0
                if rank is None and (rank := self.words.get(plain[a:b])) is not None:
                    leet = 1.0 + sum(x != y for x, y in zip(low[a:b], plain[a:b]))
                if rank is not None:
                    upper = sum(c.isupper() for c in value[a:b])
                    case = 0.0 if not upper else 1.0 if upper == b - a or (upper == 1 and value[a].isupper()) else math.log2(math.comb(b - a, upper)) + 1
                    add(a, b, rank + leet + case, "word")
            if value[a].isdigit():
                for size in (4, 6, 8, 9, 10):
                    if a + size <= n and (bits := _date_bits(value[a:a + size])) is not None:
                        add(a, a + size, bits, "date")
        a = 0
        while a < n:  # walks: maximal runs of neighbouring keys
            b, turns, last = a + 1, 0, None
            while b < n and (low[b - 1], low[b]) in self.steps:
                step = ord(low[b]) - ord(low[b - 1])
                turns += last is not None and (step > 0) != (last > 0)
                last, b = step, b + 1
            if b - a >= 3:
                add(a, b, math.log2(47) + 2 * turns + math.log2(b - a), "walk")
            a = max(b - 1, a + 1)
        for unit in range(1, REPEAT_UNIT + 1):  # repeats: maximal runs with this period
            a = 0
            while a + 2 * unit <= n:
                b = a + unit
                while b < n and value[b] == value[b - unit]:
                    b += 1
                times = (b - a) // unit
                if times >= 2 and times * unit >= 3:
                    add(a, a + times * unit, unit * char + math.log2(times), "repeat")
                a = max(a + 1, b - unit + 1)
        if self.letters is not None:
            for m in re.finditer(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}", value):
                add(m.start(), m.end(), float(self.letters[letter_triples(f"  {m[0]} ".encode())].sum()) + (not m[0].islower()), "word")
        return found

    def __call__(self, value: str) -> tuple[float, list[tuple[int, int, str]]]:
        """(bits, segments as (start, end, kind)) of the cheapest segmentation."""
        n, found, char = len(value), self._segments(value), char_bits(value)
        # closed[i]: cheapest for value[:i] with a segment ending there; brute[i]: inside a brute-force span
        closed, brute = [0.0] + [math.inf] * n, [math.inf] * (n + 1)
        how: list[tuple[int, str]] = [(0, "")] * (n + 1)
        since = [0] * (n + 1)
        for i in range(1, n + 1):
            fresh = closed[i - 1] + SEGMENT_BITS
            since[i] = i - 1 if fresh < brute[i - 1] else since[i - 1]
            brute[i] = min(fresh, brute[i - 1]) + char
            closed[i], how[i] = brute[i], (since[i], "brute")
            for a, bits, kind in found.get(i, ()):
                if closed[a] + SEGMENT_BITS + bits < closed[i]:
                    closed[i], how[i] = closed[a] + SEGMENT_BITS + bits, (a, kind)
        segments, at = [], n
        while at:
            a, kind = how[at]
            segments.append((a, at, kind))
            at = a
        return closed[n], segments[::-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def guess_spans(text: str, base: list[tuple[int, int, int]], cost: GuessCost, min_bits: float) -> tuple[list[tuple[int, int, int]], float]:
    """Values of 8 characters or more in a credential context, clear of base spans, that cost
    ``min_bits`` or more to guess; and the dearest cost of all the values."""
    spans, dearest = [], 0.0
    if ":" not in text and "=" not in text:
        return spans, dearest
    starts, ends = [], []  # the base spans, joined where they touch
    for x, _, y in base:
        if ends and x <= ends[-1]:
            ends[-1] = max(ends[-1], y)
        else:
            starts.append(x)
            ends.append(y)
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".,;:!?)]}")
        a, b = m.start(1), m.start(1) + len(value)
        before = bisect_left(starts, b)
        if len(value) < MIN_VALUE or before and ends[before - 1] > a:
            continue
        bits, _ = cost(value)
        dearest = max(dearest, bits)
        if bits >= min_bits:
            spans.append((a, 3, b))
    return spans, dearest


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def _scan(min_bits: float, letters: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = GuessCost(letters)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                base = base_spans(text)
                more, dearest = guess_spans(text, base, cost, min_bits)
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                out.append((doc_id, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)), len(more), dearest))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(SPANS), SPANS)], schema=SPANS)

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bits: float = GUESS_BITS) -> DataFrame:
    """Secrets in each whole text: one row per input row, repeated rows included.

    ``spans`` lists kind:start:end in code points (end exclusive) by start, then kind; ``n_guess``
    counts those that the guess cost added, values of :data:`MIN_VALUE` characters or more that cost
    ``min_bits``; all documents are read once before, for their letters. A null or empty text has no spans (an empty string); a
    null id is kept; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(_scan(min_bits, letter_bits(count_letters(rows.select("text")))), ddl(SPANS))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return scan_secrets(table(spark, sf_dir, "documents"))
