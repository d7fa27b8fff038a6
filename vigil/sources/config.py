"""Settings of a run: a JSON file, overlaid by the environment, checked; and the list of channels with their own overrides."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Messages of a pass by default and at most.
BATCH_LIMIT, BATCH_MOST = 100, 5000
# End of fixed values.
_CURSOR = "struct<kind:string,messageId:long,dateIso:string>"
_CONFIG = f"batchLimit double, markAsRead boolean, cursor {_CURSOR}"
_MANIFEST = f"version long, channels array<struct<key:string,telegramTarget:string,title:string,enabled:boolean,parseOverrides:struct<batchLimit:double,markAsRead:boolean,cursor:{_CURSOR}>>>"
_YES = ("1", "true", "yes")


def read_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The object or the array of objects in a JSON file; an absent file has none."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _limit(value: float | None, default: int) -> int:
    if value is None:
        return default
    if value != int(value) or not 1 <= value <= BATCH_MOST:
        raise ValueError(f"batchLimit has to be a whole number of 1 to {BATCH_MOST}, not {value:g}")
    return int(value)


def _cursor(row) -> dict | None:
    """Where to go on: after a message or at a date."""
    if row is None:
        return None
    if row["kind"] == "message_id" and row["messageId"] is not None and row["messageId"] >= 0:
        return {"kind": "message_id", "message_id": row["messageId"]}
    if row["kind"] == "date" and row["dateIso"]:
        return {"kind": "date", "date": row["dateIso"]}
    raise ValueError("a cursor has a message_id or a date")


def parse_config(spark: SparkSession, path: str, environ: Mapping[str, str] | None = None) -> dict:
    """batch_limit, mark_as_read and cursor: the file's (an absent one has none), over them VIGIL_PARSE_BATCH_LIMIT and
    VIGIL_PARSE_MARK_AS_READ (1, true or yes; it can't take back what the file says), else the defaults.

    VIGIL_PARSE_CONFIG names another file, below the folder of `path` where it isn't absolute.
    """
    env = os.environ if environ is None else environ
    other = env.get("VIGIL_PARSE_CONFIG", "").strip()
    if other:
        path = other if "://" in other or other.startswith("/") else f"{path.rpartition('/')[0]}/{other}"
    rows = read_json(spark, path, _CONFIG).limit(2).collect()
    row = rows[0] if len(rows) == 1 else {"batchLimit": None, "markAsRead": None, "cursor": None}  # an array is no config
    limit, text = row["batchLimit"], env.get("VIGIL_PARSE_BATCH_LIMIT", "").strip()
    if text:
        try:
            limit = float(text)
        except ValueError:
            raise ValueError(f"batchLimit has to be a number, not {text}") from None
    marked = env.get("VIGIL_PARSE_MARK_AS_READ", "").strip().lower() in _YES
    return {"batch_limit": _limit(limit, BATCH_LIMIT), "mark_as_read": marked or bool(row["markAsRead"]), "cursor": _cursor(row["cursor"])}


def _wrong(limit: Column) -> Column:
    return limit.isNotNull() & ((limit != F.floor(limit)) | (limit < 1) | (limit > BATCH_MOST))


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    """key, target, title, enabled, and batch_limit and mark_as_read where a channel has its own; an absent manifest lists nothing.

    What answers.plan_channels takes, with the parse config as defaults. A manifest of another version, a channel without key or target, and a limit out of range are errors.
    """
    rows = read_json(spark, path, _MANIFEST)
    if rows.where(~F.col("version").eqNullSafe(1)).limit(1).count():
        raise ValueError("the manifest's version has to be 1")
    c = rows.select(F.explode("channels").alias("c")).select("c.*")
    blank = lambda n: F.coalesce(F.col(n), F.lit("")) == ""
    limit = F.col("parseOverrides.batchLimit")
    bad = c.where(blank("key") | blank("telegramTarget") | _wrong(limit)).limit(1).collect()
    if bad:
        raise ValueError(f"a channel needs a key, a target and a limit of 1 to {BATCH_MOST}: {bad[0].asDict()}")
    return c.select("key", F.col("telegramTarget").alias("target"), "title", F.coalesce("enabled", F.lit(True)).alias("enabled"), limit.cast("int").alias("batch_limit"), F.col("parseOverrides.markAsRead").alias("mark_as_read"))
