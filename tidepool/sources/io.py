"""Sources and sinks (#1-#15).

Readers dispatch on the extension; CSV charset detection decodes all raw lines strictly with each
candidate, in a distributed pass, before choosing the decoder. Writers are plain
DataFrame writes; a split is a version of the artefact store.
"""

from __future__ import annotations

import csv
import itertools
import os
import re
import sys
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions.columns import nan_to_null
from tidepool.session import scratch_folder
from tidepool.sources.store import current, publish

# the decoders run in Python workers: ship this module's code by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Charsets tried in order when a CSV is not valid UTF-8.
FALLBACK_ENCODINGS = ["utf-8", "utf-8-sig", "gbk", "gb2312", "gb18030", "latin-1"]
# Extensions accepted by the reader (case-insensitive) and their Spark formats.
READERS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc", ".txt": "csv"}
# M4 seasonal pattern → (horizon, frequency, history size).
M4_INFO = [
    ("Yearly", 6, 1, 1.5),
    ("Quarterly", 8, 4, 1.5),
    ("Monthly", 18, 12, 1.5),
    ("Weekly", 13, 1, 10.0),
    ("Daily", 14, 1, 10.0),
    ("Hourly", 48, 24, 10.0),
]

# Charsets that Spark's own reader decodes.
_SPARK_CHARSET = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "latin-1": "ISO-8859-1"}


def extension(path: str) -> str:
    return os.path.splitext(path)[1].lower()


# A record separator for copies of CSV texts: the first of these control characters that the text lacks.
SEPARATORS = [chr(c) for c in (0x1E, 0x1F, 0x1D, 0x1C, *range(1, 9), *range(0x0E, 0x1C))]


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The raw lines with the file and the byte range of it that a task reads them from, in file order."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _by_range(batches):
    """(file, start, lines in order) of the byte ranges that the batches hold, a batch at a time."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("file", "start", "line")))
        for (file, start), part in itertools.groupby(rows, key=lambda r: r[:2]):
            yield file, start, [r[2] for r in part]


def _survey(encodings: Sequence[str]):
    def run(batches):
        failed, odd, found, quotes = set(), False, set(), {}
        for file, start, lines in _by_range(batches):
            counts = [line.count(b'"') for line in lines]
            odd = odd or any(n % 2 for n in counts)
            quotes[file, start] = quotes.get((file, start), 0) + sum(counts)
            text = b"\n".join(lines)
            found.update(c for c in SEPARATORS if c.encode() in text)
            for e in encodings:
                if e not in failed:
                    try:
                        text.decode(e)
                    except UnicodeDecodeError:
                        failed.add(e)
        rows = [(f, s, n % 2, odd, sorted(failed), sorted(found)) for (f, s), n in quotes.items()]
        if rows:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["file", "start", "parity", "odd", "failed", "found"])

    return run


@dataclass(frozen=True)
class CsvSurvey:
    """What one pass over a CSV text's raw lines found."""

    encoding: str
    multi_line: bool  # a quoted field holds a line end
    separator: str | None  # a control character that the text lacks
    ranges: DataFrame  # (file, start, parity): the quotes in each byte range, odd or even


def survey_csv(spark: SparkSession, path: str, encodings: Sequence[str] = FALLBACK_ENCODINGS) -> CsvSurvey:
    """The first charset that decodes every line strictly, and whether a quoted field holds a line end:
    an odd number of quotes in a line means that a quoted field goes on in the next one."""
    ranges = _numbered_lines(spark, path).mapInArrow(_survey(list(encodings)), "file string, start bigint, parity bigint, odd boolean, failed array<string>, found array<string>")
    stored = f"{scratch_folder(spark, 'csv')}/ranges"
    ranges.write.parquet(stored)  # one row for each byte range
    ranges = spark.read.schema(ranges.schema).parquet(stored)
    flat = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    odd, failed, found = ranges.agg(F.max("odd"), flat("failed"), flat("found")).first()
    left = [e for e in encodings if e not in (failed or ())]
    if not left:
        raise ValueError(f"{path} is text in none of the charsets {', '.join(encodings)}")
    return CsvSurvey(left[0], bool(odd), next((c for c in SEPARATORS if c not in (found or ())), None), ranges.select("file", "start", "parity"))


def inspect_csv(spark: SparkSession, path: str, encodings: Sequence[str] = FALLBACK_ENCODINGS) -> tuple[str, bool]:
    """(charset, whether a quoted field holds a line end) of a CSV text, see :func:`survey_csv`."""
    found = survey_csv(spark, path, encodings)
    return found.encoding, found.multi_line


def detect_csv_encoding(spark: SparkSession, path: str, encodings: Sequence[str] = FALLBACK_ENCODINGS) -> str:
    return inspect_csv(spark, path, encodings)[0]


_PIECES = "kind string, file string, start bigint, text string"


def _records(encoding: str):
    """Lines of byte ranges, each known to begin inside a quoted field or not, as records: whole ones, the
    file's first one (header), and the pieces of those that reach over the ends of a range."""
    def run(batches):
        key, held, inside, whole, out = None, [], False, True, []

        def emit(kind: str) -> None:
            out.append((kind, *key, b"\n".join(held).removesuffix(b"\r").decode(encoding) if kind != "middle" else b"\n".join(held).decode(encoding)))
            held.clear()

        def flushed():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.string()))],
                                               names=["kind", "file", "start", "text"])
            out.clear()
            return batch

        for batch in batches:
            for file, start, begins, line in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "inside", "line"))):
                if (file, start) != key:
                    if held:
                        emit("middle" if whole else "tail")
                    # whole: no record has ended in the range yet, so what there is began before it
                    key, inside, whole, first = (file, start), begins, begins, start == 0
                held.append(line)
                inside ^= line.count(b'"') % 2 == 1
                if not inside:
                    emit("head" if whole else "header" if first else "record")
                    whole = first = False
            if out:
                yield flushed()
        if held:
            emit("middle" if whole else "tail")
            yield flushed()

    return run


def csv_records(spark: SparkSession, path: str, found: CsvSurvey) -> tuple[DataFrame, str | None]:
    """(records, header): the text of every record of the files, quoted line ends included, and that of
    the first file's first one, which every file has.

    Whether a byte range begins inside a quoted field follows from the parity of the quotes before it, so
    all ranges are read at once; records that reach over the end of a range are put together from pieces.
    """
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begins = found.ranges.select("file", "start", (F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    # one short row for each byte range of at least megabytes: small beside what it describes
    lines = _numbered_lines(spark, path).join(F.broadcast(begins), ["file", "start"], "left")
    lines = lines.select("file", "start", F.coalesce("inside", F.raise_error(F.lit("a byte range was not surveyed")).cast("boolean")).alias("inside"), "line")
    folder = scratch_folder(spark, "csv")
    pieces = lines.mapInArrow(_records(found.encoding), _PIECES)
    pieces.write.parquet(f"{folder}/pieces")
    pieces = spark.read.schema(pieces.schema).parquet(f"{folder}/pieces")
    cut = pieces.where(F.col("kind").isin("tail", "middle", "head"))
    order = Window.partitionBy("file").orderBy("start", F.col("kind") == "tail").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("owner", F.last(F.when(F.col("kind") == "tail", F.col("start")), True).over(order))
    joined = cut.groupBy("file", "owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda p: p["text"]), "\n").alias("text"))
    header = pieces.where("kind = 'header'").orderBy("file").select("text").first()
    return pieces.where("kind = 'record'").select("text").unionByName(joined.select("text")), header["text"] if header else None


def _header_names(header: str) -> list[str]:
    names = next(csv.reader([header.removeprefix("\ufeff")]))
    twice = {n for n in names if names.count(n) > 1}
    return [f"_c{i}" if not n else f"{n}{i}" if n in twice else n for i, n in enumerate(names)]


def _read_records(spark: SparkSession, path: str, found: CsvSurvey, schema) -> DataFrame:
    """A CSV text with line ends in quoted fields, or in a charset that Spark's reader lacks: its records
    are stored as UTF-8 with a separator of their own, so that this copy splits anywhere."""
    records, header = csv_records(spark, path, found)
    names = _header_names(header) if header is not None else []
    target = f"{scratch_folder(spark, 'csv')}/text"
    records.write.option("lineSep", found.separator).text(target)
    reader = spark.read.option("lineSep", found.separator).option("escape", '"').option("quote", '"')
    if schema is not None:
        return reader.schema(schema).csv(target)
    df = reader.option("inferSchema", True).csv(target)
    if not df.columns:  # a header and no rows
        return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return df.toDF(*(names + df.columns[len(names):])[:len(df.columns)])


def nan_as_null(df: DataFrame) -> DataFrame:
    """NaN → null in every float column: a table's missing numbers are nulls from the start."""
    return df.select(*[nan_to_null(f.name).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def read_table(spark: SparkSession, path: str, encodings: Sequence[str] | None = None, schema=None,
               fmt: str | None = None) -> DataFrame:
    """Read by extension (csv, parquet, json, orc) or an explicit ``fmt`` (e.g. a directory of parts).

    CSV infers header and schema and finds the charset; quoted fields may hold line ends, and files are
    read by many tasks all the same. NaN is read as null.
    """
    if fmt is None:
        ext = extension(path)
        if ext not in READERS:
            raise ValueError(f"no reader for files named *{ext}; there are readers for {', '.join(READERS)}")
        fmt = READERS[ext]
    if fmt == "csv":
        found = survey_csv(spark, path, encodings or FALLBACK_ENCODINGS)
        charset = _SPARK_CHARSET.get(found.encoding)
        if found.multi_line or charset is None:
            if found.separator is None:
                raise ValueError(f"{path} holds every control character, so none can separate its records")
            return nan_as_null(_read_records(spark, path, found, schema))
        reader = spark.read.option("header", True).option("encoding", charset).option("escape", '"')
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        return nan_as_null(reader.csv(path))
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return nan_as_null(reader.format(fmt).load(path))


def list_files(spark: SparkSession, directory: str) -> list[str]:
    """Files in ``directory``, and folders of parts named like a file of a known format, through the
    Hadoop file system (works for any cluster store)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(directory)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return []
    return sorted(str(s.getPath().toString()) for s in fs.listStatus(p)
                  if s.isFile() or extension(str(s.getPath().getName())) in READERS)


def read_first_supported(spark: SparkSession, directory: str) -> DataFrame | None:
    """The first file (by name) with a supported extension that loads; unsupported ones are skipped."""
    for f in list_files(spark, directory):
        if extension(f) not in READERS:
            continue
        try:
            return read_table(spark, f)
        except (AnalysisException, ValueError):  # not in the format that its name says
            continue
    return None


def read_matching(spark: SparkSession, directory: str, pattern: str, suffix: str = ".csv", fmt: str | None = None,
                  **options) -> DataFrame:
    """Files in ``directory`` ending in ``suffix`` whose path matches ``pattern``; error when none."""
    names = [f for f in list_files(spark, directory) if f.endswith(suffix) and re.search(pattern, f)]
    if not names:
        raise FileNotFoundError(f"nothing in {directory} that ends in {suffix} matches {pattern!r}")
    fmt = fmt or READERS.get(suffix.lower(), "csv")
    reader = spark.read.format(fmt).option("pathGlobFilter", f"*{suffix}")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(names).withColumn("source_file", F.col("_metadata.file_path"))


def series_arrays_to_long(df: DataFrame, sample_col: str, dims: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per sample with one array per dimension → (sample, t, dim values...)."""
    z = F.arrays_zip(*[F.col(d).alias(d) for d in dims])
    exploded = df.select(sample_col, *keep, F.posexplode(z).alias("t", "_r"))
    return exploded.select(sample_col, *keep, "t", *[F.col(f"_r.{d}").cast("double").alias(d) for d in dims])


def series_lengths(df: DataFrame, sample_col: str, dims: Sequence[str]) -> DataFrame:
    """Per sample: length of each dimension, whether they differ (ragged) and the longest length."""
    lens = [F.size(d).alias(f"len_{d}") for d in dims]
    out = df.select(sample_col, *lens)
    ls = [F.col(f"len_{d}") for d in dims]
    return out.withColumn("ragged", F.greatest(*ls) != F.least(*ls) if len(ls) > 1 else F.lit(False)).withColumn(
        "length", F.greatest(*ls) if len(ls) > 1 else ls[0])


def load_forecast_table(df: DataFrame, target: str, features: str = "M", date_col: str | None = None) -> DataFrame:
    """Date column (``date`` or else the first non-target column) renamed ``date``; order date, others,
    target. ``M``/``MS`` keep all value columns, ``S`` only the target."""
    cols = [c for c in df.columns if c != target]
    dc = date_col or ("date" if "date" in cols else cols[0])
    others = [c for c in cols if c != dc]
    out = df.select(F.col(dc).alias("date"), *others, target)
    if features == "S":
        return out.select("date", target)
    return out


def m4_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(M4_INFO, "pattern string, horizon int, frequency int, history_size double")


def m4_lookup(df: DataFrame, pattern_col: str = "SP") -> DataFrame:
    """Attach horizon, frequency and history size by seasonal pattern (6-row broadcast dimension)."""
    dim = F.broadcast(m4_dimension(df.sparkSession))
    return df.join(dim, df[pattern_col] == dim["pattern"], "left").drop("pattern")


def m4_select_group(df: DataFrame, pattern: str, pattern_col: str = "SP", values_col: str = "values") -> DataFrame:
    """Rows of one seasonal group with nulls and NaN removed from each value array."""
    return df.where(F.col(pattern_col) == pattern).withColumn(
        values_col, F.filter(values_col, lambda x: x.isNotNull() & ~F.isnan(x)))


def load_anomaly_triplet(train: DataFrame, test: DataFrame, labels: DataFrame | None, order_by: str,
                         drop_first: bool = True, label_inside: str | None = None, val_keep: float = 0.8):
    """Anomaly loader: drop the leading id column (or split the trailing label), NaN→0, z-score fitted
    on train, validation = last 20 % of train, test labels attached by row index.

    Returns (train, val, test) with a dense ``row_idx`` and ``label`` on test.
    """
    from tidepool.operators.clean import nan_to_zero
    from tidepool.operators.scale import apply_scaler, fit_scaler
    from tidepool.plans.order import with_row_index

    def values_of(df: DataFrame) -> list[str]:
        cols = [c for c in df.columns if c != label_inside]
        return cols[1:] if drop_first else cols

    tr_idx, n_tr = with_row_index(train, [order_by])
    te_idx, _ = with_row_index(test, [order_by])
    vals = [c for c in values_of(train)]
    tr = nan_to_zero(tr_idx.select("row_idx", *vals), vals)
    te = nan_to_zero(te_idx.select("row_idx", *vals, *([label_inside] if label_inside else [])), vals)
    params = fit_scaler(tr, vals, "mean")
    tr, te = apply_scaler(tr, params), apply_scaler(te, params)
    start = int(n_tr * val_keep)
    val = tr.where(F.col("row_idx") >= start).withColumn("row_idx", F.col("row_idx") - start)
    if label_inside:
        te = te.withColumnRenamed(label_inside, "label")
    elif labels is not None:
        lab_idx, _ = with_row_index(labels, [labels.columns[0]])
        lab = lab_idx.select("row_idx", F.col(labels.columns[-1]).alias("label"))
        te = te.join(lab, "row_idx", "left")
    return tr, val, te


def write_dataset(df: DataFrame, root: str, name: str, fmt: str = "parquet") -> str:
    path = os.path.join(root, name)
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)
    return path


def prediction_export(scored: DataFrame, key: str = "row_id") -> DataFrame:
    """index, true_value, prediction and (for classifiers) confidence = max class probability."""
    cols = [F.col(key).alias("index"), F.col("y").alias("true_value"), F.col("yhat").alias("prediction")]
    if "probability" in scored.columns:
        cols.append(F.array_max("probability").alias("confidence"))
    return scored.select(*cols)


def write_predictions(scored: DataFrame, path: str, fmt: str = "csv", key: str = "row_id") -> None:
    out = prediction_export(scored, key)
    w = out.write.mode("overwrite")
    (w.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else w.format(fmt).save(path))


def write_history(history: DataFrame, path: str, fmt: str = "csv") -> None:
    cols = [c for c in ("epoch", "train_loss", "val_loss", "train_metric", "val_metric") if c in history.columns]
    w = history.select(*cols).write.mode("overwrite")
    (w.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else w.format(fmt).save(path))


SPLIT_KEYS = ("task_type", "n_classes", "feature_names", "target_name", "classes", "input_dim", "is_time_series",
              "seq_len", "pred_len", "label_len", "scaler", "target_scaler")


def save_split(train: DataFrame, test: DataFrame, meta: dict, root: str) -> None:
    """Both sides as Parquet and the metadata (known keys only) as one version: a reader gets all of it
    or the version before."""
    def write(folder: str) -> None:
        train.write.parquet(f"{folder}/train")
        test.write.parquet(f"{folder}/test")

    publish(train.sparkSession, root, write, {k: v for k, v in meta.items() if k in SPLIT_KEYS})


def load_split(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, dict] | None:
    """What ``save_split`` stored last; None where nothing is. Any other failure is raised."""
    version = current(spark, root)
    if version is None:
        return None
    sides = (spark.read.parquet(f"{version.folder}/{side}") for side in ("train", "test"))
    return (*sides, {k: v for k, v in version.about.items() if k in SPLIT_KEYS})
