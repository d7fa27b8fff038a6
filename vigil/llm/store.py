"""Shared working folder: where an operator cuts its lineage or writes a table that later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one is set, but on one machine only:
    tasks of a cluster do not share their disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            if not (context.master or "").startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="vigil-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """What this application writes, in one folder of its own."""
    return f"{shared_dir(spark)}/vigil-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later steps start from files that outlive any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB instead of 64: a batch is held several times over, by the JVM and by Python. A setting of the user's stays."""
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
    if str(spark.conf.get(name, str(default))).rstrip("b") == str(default):
        spark.conf.set(name, str(8 << 20))


def clear(spark: SparkSession) -> None:
    """Delete all working tables of this application. To be called once its results are stored: they read these tables until then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
