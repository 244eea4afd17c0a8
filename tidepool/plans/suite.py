"""Checked queries: each operator applied to the driver's tables, with an equivalent DuckDB SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> SQL``. Floating outputs are
rounded to 6 decimals on both sides so that the value hashes agree. Every query reads whole
tables; nulls needed by fill operators are derived from the data (``key % k = 0`` → null), never
by dropping rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DIGITS = 6


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return normalized_types(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = oracle_text(sql)
        return fn
    return deco


def normalized_types(df: DataFrame) -> DataFrame:
    """All integer columns as bigint and session-zone timestamps as wall-clock timestamp_ntz, so
    the result types line up with the oracle's (BIGINT, TIMESTAMP) whatever the session zone."""
    out, changed = [], False
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
            changed = True
        elif isinstance(f.dataType, T.TimestampType):
            out.append(F.col(f.name).cast("timestamp_ntz").alias(f.name))
            changed = True
        else:
            out.append(F.col(f.name))
    return df.select(*out) if changed else df


# Oracle output columns that DuckDB types as INTEGER or HUGEINT; they are cast to BIGINT so that
# both sides agree (Spark results have every integer column as bigint).
NARROW_INT_OUTPUTS = {
    "assemble_features": ["pos"], "assemble_value_and_mark": ["pos"], "columns_with_nulls": ["columns_with_nulls"],
    "describe_categorical": ["count"], "drop_columns": ["l_linenumber"], "fold_holdout": ["l_linenumber"],
    "iqr_filter": ["l_linenumber"], "kfold": ["l_linenumber", "fold"], "label_decode": ["code"],
    "label_dictionary": ["code"], "label_encode": ["l_linenumber", "l_returnflag"], "load_anomaly_triplet": ["label"],
    "m4_lookup": ["horizon", "frequency"], "multiscale_tails": ["scale"], "overlap_windows": ["feat"],
    "prediction_export": ["true_value", "prediction"], "preview": ["l_linenumber"], "profile_schema": ["position"],
    "profile_shape": ["n_cols"], "random_split": ["l_linenumber"], "read_first_supported": ["l_linenumber"],
    "read_matching": ["l_linenumber"], "read_table_csv": ["l_linenumber"], "save_load_split": ["l_linenumber"],
    "scale_decoder_input": ["feat"], "scale_windows": ["feat"], "sliding_windows": ["feat"],
    "strided_windows": ["feat"], "tiling_windows": ["feat"], "write_dataset": ["l_linenumber"],
    "seq2seq_windows": ["feat"], "drop_duplicates": ["l_linenumber"], "fill_report": ["nulls_after"],
    "read_csv_latin1": ["l_linenumber"], "read_csv_gb18030": ["l_linenumber"], "read_csv_multiline": ["l_linenumber"],
}


def oracle_sql_typed() -> dict[str, str]:
    out = {}
    for name, sql in ORACLE.items():
        cols = NARROW_INT_OUTPUTS.get(name)
        if cols:
            casts = ", ".join(f'cast("{c}" as bigint) as "{c}"' for c in cols)
            sql = f"select * replace ({casts}) from ({sql}) as q"
        out[name] = sql
    return out


def oracle_text(sql: str) -> str:
    """Make DuckDB's ``round(x, d)`` round like Spark's: Spark rounds the shortest decimal form of
    the double half-up (so 5.3326465 → 5.332647 and never a negative zero); DuckDB rounds the
    binary value. Each ``round(x, d)`` becomes a rounding of ``x`` printed and read as a decimal."""
    return _spark_round(sql.strip())


def _spark_round(sql: str) -> str:
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, comma, k = 0, None, j + 5
        for k in range(j + 5, len(sql)):
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
                if depth == 0:
                    break
            elif ch == "," and depth == 1:
                comma = k
        arg, digits = _spark_round(sql[j + 6:comma]), sql[comma + 1:k].strip()
        out.append(sql[i:j])
        out.append(f"cast(round(cast(cast({arg} as varchar) as decimal(38, 18)), {digits}) as double)")
        i = k + 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every float column (and float arrays) to ``digits`` decimals."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# ----------------------------------------------------------------------------- shared derivations

def events_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with value null at event_id % 7 = 0 and event_type null at event_id % 5 = 0."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id", "ts", "user_id",
        F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"),
    )


EVENTS_NULLS_SQL = """
(select event_id, ts, user_id,
        case when event_id % 5 = 0 then null else event_type end as event_type,
        case when event_id % 7 = 0 then null else value end as value
 from events)"""


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events aggregated to an hourly series: (hour, value = avg value, n = count)."""
    ev = table(spark, sf_dir, "events")
    # date_trunc returns a session-zone timestamp: cast back to wall-clock time
    return ev.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))


HOURLY_SQL = """
(select date_trunc('hour', ts) as hour, avg(value) as value, count(*) as n from events group by 1)"""


# importing the query modules registers them
from tidepool.plans import suite_prep  # noqa: E402,F401
from tidepool.plans import suite_more  # noqa: E402,F401
from tidepool.plans import suite_models  # noqa: E402,F401
from tidepool.plans import suite_io  # noqa: E402,F401
from tidepool.plans import suite_extra  # noqa: E402,F401
from tidepool.plans import suite_series  # noqa: E402,F401
