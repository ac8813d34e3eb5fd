"""Versioned snapshots of tables that change together.

Parquet tables take no row updates, so a job writes whole new versions, each attempt into
folders of its own, and publishes them with one line per table in a manifest file written
last. ``read_all_published`` reads the manifest once for all tables it gives, so a reader sees
every table of a batch or none, and never one batch of this table and another of that. A
batch run again takes the place of its earlier attempt for readers that come later; those
at work keep the folders they began with.
"""

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# finished_at tells the attempts of one batch apart
_MANIFEST = "batch_id bigint, finished_at bigint, table_name string, path string, fields string"


def publish(spark: SparkSession, root: str, batch_id: int, tables: dict) -> None:
    """Write every table of a batch, then the manifest that makes it visible."""
    attempt, entries = uuid.uuid4().hex, []
    for name, df in sorted(tables.items()):
        path = f"{root}/{name}/version={batch_id}/attempt={attempt}"
        df.write.parquet(path)
        entries.append((name, path, df.schema.json()))
    finished = time.time_ns()
    rows = spark.createDataFrame([(batch_id, finished, *e) for e in entries], _MANIFEST)
    rows.coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")


def latest_batch(spark: SparkSession, root: str, name: str):
    """The newest published batch holding ``name``, or None."""
    return _manifest(spark, root).where(F.col("table_name") == name).agg(
        F.max("batch_id")).first()[0]


def read_all_published(spark: SparkSession, root: str, names) -> dict:
    """The newest version of every table named, all as of one moment, by name."""
    newest = F.max_by(F.struct("path", "fields"), F.struct("batch_id", "finished_at"))
    found = {row["table_name"]: row["newest"] for row in _manifest(spark, root).where(
        F.col("table_name").isin(list(names))).groupBy("table_name").agg(
        newest.alias("newest")).collect()}
    missing = sorted(set(names) - set(found))
    if missing:
        raise ValueError(f"no published version of {missing} under {root}")
    return {name: spark.read.schema(T.StructType.fromJson(json.loads(entry["fields"])))
            .parquet(entry["path"]) for name, entry in found.items()}


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table alone; tables that belong together go through ``read_all_published``."""
    return read_all_published(spark, root, [name])[name]
