"""Versioned artefacts (#13, #14, #114): what belongs together appears together, or not at all.

A writer stores all parts of a version in a folder of its own, which no reader looks at, and then
publishes one small manifest, by renaming a finished file. A version counts once its manifest is there:
a writer that dies leaves the old one readable. Of several manifests the last is current; versions are
never changed in place. The manifest holds the run's row, so the runs table is the list of manifests.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Version:
    number: int
    folder: str
    about: dict


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _manifests(spark: SparkSession, root: str) -> list[str]:
    files, place = _files(spark, f"{root}/manifests")
    if not files.exists(place):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(place) if s.getPath().getName().endswith(".json"))


def _read(spark: SparkSession, path: str) -> str:
    files, place = _files(spark, path)
    stream = files.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, write: Callable[[str], None], about: dict | None = None) -> Version:
    """Call ``write(folder)`` for a new version's parts, then make the version current.

    If ``write`` fails, or the process ends before the last step, readers see what they saw before. Two
    writers at once make two versions; both see the same one as current, that with the larger name.
    """
    folder = f"{root}/versions/{uuid.uuid4().hex}"
    write(folder)
    names = _manifests(spark, root)
    number = int(names[-1].split("-")[0]) + 1 if names else 1
    manifest = {"number": number, "folder": folder, "about": about or {}}
    name = f"{number:012d}-{uuid.uuid4().hex}.json"
    files, aside = _files(spark, f"{root}/manifests/.{name}.part")
    stream = files.create(aside, True)
    try:
        stream.write(json.dumps(manifest).encode())
    finally:
        stream.close()
    if not files.rename(aside, _files(spark, f"{root}/manifests/{name}")[1]):
        raise OSError(f"the manifest {name} could not be published in {root}")
    return Version(**manifest)


def versions(spark: SparkSession, root: str) -> list[Version]:
    """All published versions, the oldest first."""
    return [Version(**json.loads(_read(spark, f"{root}/manifests/{name}"))) for name in _manifests(spark, root)]


def current(spark: SparkSession, root: str) -> Version | None:
    """The version published last; None where none is."""
    names = _manifests(spark, root)
    return Version(**json.loads(_read(spark, f"{root}/manifests/{names[-1]}"))) if names else None


def publish_model(model, root: str, project: str, model_type: str, task_type: str, target: str, metrics: dict[str, float],
                  is_time_series: bool | None = None, created_at: datetime | None = None) -> Version:
    """Store a fitted model and its row of the runs table as one version."""
    from tidepool.operators.models import save_model

    at = created_at or datetime.now(timezone.utc).replace(tzinfo=None)
    run = {"project": project, "run_id": uuid.uuid4().hex, "model_type": model_type, "task_type": task_type, "is_time_series": is_time_series,
           "target": target, "created_at": at.isoformat(), "metrics": {k: float(v) for k, v in metrics.items()}}
    return publish(SparkSession.active(), root, lambda folder: save_model(model, f"{folder}/model"), run)


def current_model(spark: SparkSession, root: str):
    """(model, its run) published last; None where none is."""
    from tidepool.operators.models import load_model

    version = current(spark, root)
    return (load_model(f"{version.folder}/model"), version.about) if version else None


def runs_table(spark: SparkSession, root: str) -> DataFrame:
    """The run of every published model, read from the manifests by all tasks."""
    from tidepool.operators.runs import RUN_SCHEMA

    if not _manifests(spark, root):
        return spark.createDataFrame([], RUN_SCHEMA)
    schema = f"number bigint, folder string, about struct<{RUN_SCHEMA.replace(' timestamp_ntz', ' string')}>"
    rows = spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{root}/manifests")
    return rows.select("about.*", "folder").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
