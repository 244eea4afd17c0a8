"""Helpers that the corpus operators share.

Conventions of every operator here: the input columns are named by parameters and only those are
read, so extra columns (also ones named like a result column) cannot clash; a null text counts as
the empty text; an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.session import default_partitions, scratch_folder

# Workers need no copy of the package: functions of these modules travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def text_of(column: str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def written(df: DataFrame, folder: str | None = None, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, never a recomputation, and a table that
    was written once is the same in every later use.
    """
    spark = df.sparkSession
    path = f"{folder or scratch_folder(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, n_rows: int, rows_per_task: int = 100_000) -> DataFrame:
    """Small rows, ``n_rows`` at most, in as many tasks as they need: spares a file for each of many
    near-empty partitions."""
    return df.coalesce(max(1, -(-n_rows // rows_per_task)))


def ddl(schema: pa.Schema) -> str:
    """Spark's type string of an Arrow schema."""
    names = {"int64": "bigint", "int32": "int", "string": "string", "bool": "boolean", "double": "double", "binary": "binary",
             "list<item: int32>": "array<int>", "list<item: int64>": "array<bigint>"}
    return ", ".join(f"{f.name} {names[str(f.type)]}" for f in schema)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps, whose results are stored: it acts
    when the driver collects its garbage, which a driver with little to do does too seldom."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions_for(spark: SparkSession, n_bytes: int, target: int) -> int:
    """Tasks for ``n_bytes`` of data at ``target`` bytes each, never fewer than the session's."""
    return max(default_partitions(spark), -(-int(n_bytes) // target))


def filter_rows(docs: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Sequence[bool]]]) -> DataFrame:
    """The rows whose mask is true, with all their columns, in one pass without a shuffle. ``make``
    is called once a task and gives the function that marks a batch's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = None
        for batch in batches:
            mark = mark or make()
            yield batch.filter(pa.array(mark(batch), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def fresh_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
