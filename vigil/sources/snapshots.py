"""Keyed tables that are written: versions of immutable files and a log of commits, through Spark's own readers and writers only.

A table is a folder. `data/` holds a folder of Parquet files for each write, `log/` a one-row JSON folder for each version. A
write first stores its files, then commits the version by that row; Spark's committer makes the row visible by a rename. A
crash in between leaves files that no version names, and every reader at the version before. A commit carries a batch id, and
a batch whose id the log has already is not written again, so a stream may repeat one. Readers name a version to pin it.

One writer at a time is assumed: a version that exists already is refused, but two writers of one moment may both pass.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators import tables

_LOG = "version long, kind string, part string, batch_id string, schema string"


def working_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; on a local master alone a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="vigil-work-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{working_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df stored in the shared folder and read back: what follows starts from files that outlive any executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _committed(spark: SparkSession, path: str) -> list:
    """The log's rows in order of version: one small row for each commit."""
    try:
        return spark.read.schema(_LOG).json(f"{path}/log/*").orderBy("version").collect()
    except Exception as e:  # an absent table has no log
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise


def latest(spark: SparkSession, path: str) -> int:
    """The last committed version, 0 for a table that has none."""
    return max((r["version"] for r in _committed(spark, path)), default=0)


def _parts(log: list, version: int | None) -> list:
    """The commits that make up a version: the last whole snapshot up to it and what was appended since."""
    upto = [r for r in log if version is None or r["version"] <= version]
    if version is not None and (not upto or upto[-1]["version"] != version):
        raise ValueError(f"no version {version}")
    whole = max((i for i, r in enumerate(upto) if r["kind"] == "snapshot"), default=0)
    return upto[whole:]


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of a version, by default the last one; parts of later columns give null for earlier rows."""
    parts = _parts(_committed(spark, path), version)
    if not parts:
        raise ValueError(f"{path} has no version")
    return spark.read.schema(StructType.fromJson(json.loads(parts[-1]["schema"]))).parquet(*(f"{path}/data/{r['part']}" for r in parts))


def _write(df: DataFrame, path: str, kind: str, batch_id: str | None, rows_per_file: int | None) -> int:
    spark = df.sparkSession
    log = _committed(spark, path)
    done = next((r["version"] for r in log if batch_id is not None and r["batch_id"] == batch_id), None)
    if done is not None:
        return done
    version, part = max((r["version"] for r in log), default=0) + 1, uuid.uuid4().hex
    writer = df.write if rows_per_file is None else df.write.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(f"{path}/data/{part}")
    _commit(spark, path, (version, kind, part, batch_id, df.schema.json()))
    return version


def _commit(spark: SparkSession, path: str, row: tuple) -> None:
    spark.createDataFrame([row], _LOG).coalesce(1).write.mode("errorifexists").json(f"{path}/log/{row[0]:012d}")


def replace(df: DataFrame, path: str, batch_id: str | None = None, rows_per_file: int | None = None) -> int:
    """Make df the table's content; its version, or that of the commit which had this batch already. df may be read from the table."""
    return _write(df, path, "snapshot", batch_id, rows_per_file)


def append(df: DataFrame, path: str, batch_id: str | None = None, rows_per_file: int | None = None) -> int:
    """Add df's rows, as an outbox or a history does; rows_per_file bounds the rows of a file."""
    return _write(df, path, "append", batch_id, rows_per_file)


def put(df: DataFrame, path: str, key: list[str], order: list[str | Column], keep: tuple[str, ...] = (), batch_id: str | None = None) -> int:
    """Lay the last row of each key over the table, as a cache or a status does; columns in keep stay as they were."""
    spark = df.sparkSession
    if not _committed(spark, path):
        return replace(tables.first_per_key(df, key, order).select(*df.columns), path, batch_id)
    return replace(tables.upsert(read(spark, path), df, key, order, keep).select(*df.columns), path, batch_id)


def batch_writer(path: str, name: str, write: Callable[..., int] = append, **options: object) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: a batch that a restarted stream repeats is written once."""

    def run(batch: DataFrame, number: int) -> None:
        write(batch, path, batch_id=f"{name}-{number}", **options)

    return run
