"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise sum costs one pass,
by the identity 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2). Features are computed and scored
in the tasks; the model is a bounded matrix that travels with the job. It is fitted on a bounded
sample of the labelled rows (``sample_rows``), chosen by a hash of the id.
"""

from __future__ import annotations

import math
import operator
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import ddl, filter_rows, table, text_of, texts_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD_BUCKETS, RANK, SAMPLE_ROWS, THRESHOLD, FOLDS = 1 << 11, 8, 8000, 0.3, 5
CACHE_WORDS = 1 << 20
SYMBOLS = b"!#$%&*|<>{}[]()=+_~^@\\/"
STATS = ("log_chars", "log_declared", "log_words", "upper", "lower", "digit", "other_ascii", "space", "newline", "wide", *(f"sym_{chr(c)}" for c in SYMBOLS),
         "comma", "stop", "word_len", "distinct", "top_word", "same_as_next", "line_words", "line_repeats", "odd_endings")
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def structure(text: str, words: list[str], counts: Counter, declared: int | None) -> list[float]:
    """The statistics named in STATS; an empty text has zeros. ``declared`` is the row's n_chars."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    hist = np.bincount(raw, minlength=256)
    n, w, lines = max(1, len(raw)), max(1, len(words)), text.split("\n")
    share = lambda codes: float(hist[list(codes)].sum()) / n
    upper, lower, digit = share(range(65, 91)), share(range(97, 123)), share(range(48, 58))
    space, wide = share((9, 10, 11, 12, 13, 32)), float(hist[128:].sum()) / n
    return [math.log1p(len(text)), math.log1p(len(text) if declared is None else max(0, declared)), math.log1p(len(words)), upper, lower, digit,
            max(0.0, 1 - upper - lower - digit - space - wide) if len(raw) else 0.0, space, float(hist[10]) / n, wide, *(float(hist[c]) / n for c in SYMBOLS),
            float(hist[44]) / n, float(hist[46]) / n, (len(text) - int(hist[32])) / w, len(counts) / w, max(counts.values(), default=0) / w,
            sum(map(operator.eq, words, words[1:])) / w, math.log1p(len(words) / len(lines)), 1 - len(set(lines)) / len(lines),
            sum(n for x, n in counts.items() if not x[-1].isalnum()) / w]


class Features:
    """Hashed word counts (L2-normalised) and raw structure statistics of a text."""

    def __init__(self, buckets: int):
        self.buckets, self.cache = buckets, {}

    def __call__(self, text: str, declared: int | None) -> tuple[np.ndarray, list[float]]:
        words = text.split()
        counts, cache = Counter(words), self.cache
        for word in set(counts).difference(cache):
            cache[word] = zlib.crc32(word.encode()) % self.buckets
        at = np.fromiter(map(cache.__getitem__, counts), dtype=np.int64, count=len(counts))
        tf = np.log1p(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
        row = np.bincount(at, weights=tf, minlength=self.buckets) if len(counts) else np.zeros(self.buckets)
        if len(cache) > CACHE_WORDS:
            cache.clear()
        norm = math.sqrt(float(row @ row))
        return (row / norm if norm else row).astype(np.float32), structure(text, words, counts, declared)


@dataclass
class Machine:
    """A fitted factorisation machine; ``mean`` and ``spread`` scale the statistics."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def rows(self, words: np.ndarray, stats: np.ndarray) -> np.ndarray:
        return np.hstack([words, np.clip((stats - self.mean) / self.spread, -4, 4) / 4]).astype(np.float32)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.w0 + x @ self.w + 0.5 * ((x @ self.v) ** 2 - (x * x) @ (self.v * self.v)).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x).astype(np.float64), -40, 40)))


def fit_machine(words: np.ndarray, stats: np.ndarray, y: np.ndarray, rank: int = RANK, epochs: int = 30, batch: int = 128,
                rate: float = 0.1, penalty: float = 1e-4, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss, both classes weighing the same. No rows: every score is 0.5."""
    rng, d = np.random.default_rng(seed), words.shape[1] + stats.shape[1]
    mean = stats.mean(axis=0) if len(y) else np.zeros(stats.shape[1])
    spread = np.maximum(stats.std(axis=0), 1e-6) if len(y) else np.ones(stats.shape[1])
    m = Machine(0.0, np.zeros(d, np.float32), (rng.normal(size=(d, rank)) * 0.01).astype(np.float32), mean, spread)
    if not len(y):
        m.v[:] = 0
        return m
    x = m.rows(words, stats)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    weight = np.where(y >= 0.5, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    g0, gw, gv = 1e-8, np.full_like(m.w, 1e-8), np.full_like(m.v, 1e-8)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            xb = x[at]
            e = ((m.score(xb) - y[at]) * weight[at] / len(at)).astype(np.float32)
            sums = xb @ m.v
            dw = xb.T @ e + penalty * m.w
            dv = xb.T @ (e[:, None] * sums) - m.v * ((xb * xb).T @ e)[:, None] + penalty * m.v
            d0 = float(e.sum())
            g0 += d0 * d0
            gw += dw * dw
            gv += dv * dv
            m.w0 -= rate * d0 / math.sqrt(g0)
            m.w -= rate * dw / np.sqrt(gw)
            m.v -= rate * dv / np.sqrt(gv)
    return m


def _sampled(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        for batch in batches:
            rows = [features(t, n) for t, n in zip(batch.column("text").to_pylist(), batch.column("declared").to_pylist())]
            yield pa.record_batch([batch.column("doc_id"), batch.column("label"), pa.array([np.flatnonzero(r).astype(np.int32) for r, _ in rows], pa.list_(pa.int32())),
                                   pa.array([r[r != 0] for r, _ in rows], pa.list_(pa.float32())), pa.array([s for _, s in rows], pa.list_(pa.float64()))],
                                  names=["doc_id", "label", "at", "value", "stats"])

    return run


def _scores(features: Features, machine: Machine, texts: list[str], declared: list[int | None]) -> np.ndarray:
    scores = [np.zeros(0)]
    for at in range(0, len(texts), 256):
        rows = [features(t, n) for t, n in zip(texts[at:at + 256], declared[at:at + 256])]
        scores.append(machine.score(machine.rows(np.array([r for r, _ in rows]), np.array([s for _, s in rows]))))
    return np.concatenate(scores)


def _scored(machine: Machine, buckets: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        for batch in batches:
            scores = _scores(features, machine, batch.column("text").to_pylist(), batch.column("declared").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()),
                                   pa.array((scores >= threshold).astype(np.int32), pa.int32())], schema=SCORES)

    return run


def held_out(id_col: str, folds: int = FOLDS) -> Column:
    """Whether the id's fold is the one that training never sees; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                length_col: str | None = "n_chars", sample_rows: int = SAMPLE_ROWS, buckets: int = WORD_BUCKETS) -> Machine:
    """Fit on at most ``sample_rows`` labelled rows outside the held-out fold, the first by a hash of
    the id. Rows with a null id or label are not used; an id labelled twice counts with its mean."""
    sample = (labels.select(F.col(id_col).cast("bigint").alias("label_id"), F.col(label_col).cast("double").alias("label"))
              .filter(F.col("label_id").isNotNull() & F.col("label").isNotNull() & ~held_out("label_id"))
              .groupBy("label_id").agg(F.avg("label").alias("label")).orderBy(F.xxhash64("label_id"), "label_id").limit(sample_rows))
    rows = (_rows(docs, id_col, text_col, length_col).join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
            .select("doc_id", "label", "text", "declared"))
    found = rows.mapInArrow(_sampled(buckets), "doc_id bigint, label double, at array<int>, value array<float>, stats array<double>").toArrow()
    found = found.take(np.lexsort((found.column("label").to_numpy(), found.column("doc_id").to_numpy()))) if found.num_rows else found
    words = np.zeros((found.num_rows, buckets), dtype=np.float32)
    for row, (at, value) in enumerate(zip(found.column("at"), found.column("value"))):
        words[row, at.values.to_numpy()] = value.values.to_numpy()
    stats = np.array(found.column("stats").to_pylist(), dtype=np.float64).reshape(-1, len(STATS))
    return fit_machine(words, stats, found.column("label").to_numpy())


def _rows(docs: DataFrame, id_col: str, text_col: str, length_col: str | None) -> DataFrame:
    declared = F.col(length_col).cast("bigint") if length_col else F.lit(None).cast("bigint")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"), declared.alias("declared"))


def score_quality(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars",
                  threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row's whole text, repeated rows included.

    A null or empty text has a score like any other; a null declared length is replaced by the
    text's; a null id is kept; an empty table gives no rows. Without labels every score is 0.5.
    """
    buckets = len(machine.w) - len(STATS)
    rows = _rows(docs, id_col, text_col, length_col).select("doc_id", held_out("doc_id").alias("held_out"), "text", "declared")
    return rows.mapInArrow(_scored(machine, buckets, threshold), ddl(SCORES))


def keep_quality(docs: DataFrame, machine: Machine, text_col: str = "text", length_col: str | None = "n_chars",
                 threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least ``threshold``."""
    buckets = len(machine.w) - len(STATS)

    def make():
        features = Features(buckets)

        def mark(batch: pa.RecordBatch) -> np.ndarray:
            declared = batch.column(length_col).to_pylist() if length_col else [None] * batch.num_rows
            return _scores(features, machine, texts_of(batch, text_col), declared) >= threshold

        return mark

    return filter_rows(docs, make)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
