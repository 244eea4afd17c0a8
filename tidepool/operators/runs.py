"""Queries over a runs table (#114-#116): one row per fitted model.

Schema: project, run_id, model_type, task_type, is_time_series (nullable), target, created_at, metrics...
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.plans.order import Desc, auto_bucket_rows, with_row_index, with_series_position


def latest_runs(runs: DataFrame, project: str = "project", created_at: str = "created_at",
                run_id: str = "run_id") -> DataFrame:
    """Runs newest first per project with their rank; rank 1 is the active model.

    The rank is the position in a global (project, newest-first) index, so a project holding a
    large share of all runs is spread over several range partitions instead of one window task.
    """
    idx, n = with_row_index(runs, [project, Desc(created_at), Desc(run_id)],
                            index_col="_tp_runs_idx")
    ranked = with_series_position(idx, [project], "_tp_runs_idx", "_tp_pos",
                                  bucket_rows=auto_bucket_rows(runs.sparkSession, n))
    return ranked.select(*runs.columns, (F.col("_tp_pos") + 1).cast("int").alias("rank")).withColumn(
        "is_active", F.col("rank") == 1)


def active_runs(runs: DataFrame, project: str = "project", created_at: str = "created_at",
                run_id: str = "run_id") -> DataFrame:
    """The newest run per project as a grouped max (no per-project sort): skew-safe."""
    best = runs.groupBy(project).agg(F.max(F.struct(created_at, run_id)).alias("_b"))
    return best.select(project, F.col(f"_b.{created_at}").alias(created_at), F.col(f"_b.{run_id}").alias(run_id))


RUN_SCHEMA = ("project string, run_id string, model_type string, task_type string, is_time_series boolean, target string, "
              "created_at timestamp_ntz, metrics map<string, double>")


def record_run(spark: SparkSession, path: str, project: str, run_id: str, model_type: str, task_type: str, target: str,
               metrics: dict[str, float], is_time_series: bool | None = None, created_at: datetime | None = None) -> None:
    """Append the row of a saved model to the runs table at ``path``."""
    at = created_at or datetime.now(timezone.utc).replace(tzinfo=None)
    row = (project, run_id, model_type, task_type, is_time_series, target, at, {k: float(v) for k, v in metrics.items()})
    spark.createDataFrame([row], RUN_SCHEMA).write.mode("append").parquet(path)


def filter_runs_by_task(runs: DataFrame, time_series: bool, flag: str = "is_time_series") -> DataFrame:
    """Time-series runs when ``time_series`` is true, else general ones; a missing flag counts as general."""
    return runs.where(F.coalesce(F.col(flag), F.lit(False)) == F.lit(time_series))


def run_counts(runs: DataFrame, project: str = "project") -> DataFrame:
    return runs.groupBy(project).agg(F.count(F.lit(1)).alias("runs"))
