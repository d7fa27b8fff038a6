"""Readers and writers of the files that alert work starts from and ends in; every one is a Spark source or sink."""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import read_json

#: The first pair of numbers of the first list of coordinates in a GeoJSON text; other lists of numbers, as of a bounding box, don't count.
_PAIR = r'"coordinates"\s*:[\s\[]*(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*,\s*(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)'
REPORT_COLUMNS = ("index", "kind", "reason", "event_type", "severity", "count", "region_code", "precision", "source")


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): every .txt file of a folder, or one file, whole, ordered by name when collected in order of file."""
    return spark.read.option("wholetext", True).option("pathGlobFilter", "*.[tT][xX][tT]").text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """(code, name, full_name, fias_id, district) of a region dictionary in CSV; rows without a code are left out."""
    rows = spark.read.option("header", True).csv(path)
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    code = F.when(F.col("kladr_id").rlike(r"\d{2}"), F.substring("kladr_id", 1, 2)).when(F.col("iso_code").startswith("RU-"), F.substring("iso_code", 4, 9))
    full = F.coalesce(blank("name_with_type"), F.trim(F.concat_ws(" ", "type", "name")))
    return rows.select(code.alias("code"), F.col("name"), full.alias("full_name"), blank("fias_id").alias("fias_id"), blank("federal_district").alias("district")).where("coalesce(code, '') <> ''")


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    """(name, lon, lat) of a folder of GeoJSON files, one per city: the name stands before the first _ of the file's name."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.geojson").text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    name = F.regexp_replace(F.regexp_replace("file", r"(?i)\.geojson$", ""), "_.*$", "")
    number = lambda i: F.expr(f"try_cast(nullif(regexp_extract(value, '{_PAIR.replace(chr(92), chr(92) * 2)}', {i}), '') AS double)")
    return files.select(name.alias("name"), number(1).alias("lon"), number(2).alias("lat"))


def read_override(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array of override rows; an absent file has none."""
    return read_json(spark, path, schema)


def artifact_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(key, bytes, sha256) of every file below path; key: its path from there on."""
    root = (urlparse(path).path if ":" in path else os.path.abspath(path)).rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    below = F.substring_index("path", root + "/", -1) if root else F.col("path")
    return files.select(below.alias("key"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_artifacts(hashes: DataFrame, manifest: DataFrame) -> DataFrame:
    """(files, missing, mismatch) of a manifest (key, sha256) held against the files that are there."""
    both = manifest.select("key", F.col("sha256").alias("_want")).join(hashes.select("key", "sha256"), "key", "left")
    return both.agg(F.count(F.lit(1)).alias("files"), F.count(F.when(F.col("sha256").isNull(), 1)).alias("missing"), F.count(F.when(F.col("sha256") != F.col("_want"), 1)).alias("mismatch"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(key, sha256, bytes, source, revision) of an artifact manifest; an absent one lists nothing, an unnamed revision is unknown."""
    file = "artifactKey string, sha256 string, byteSize long, sourceId string, sourceRevision string"
    rows = read_override(spark, path, T.StructType.fromDDL(f"files array<struct<{file.replace(' string', ':string').replace(' long', ':long')}>>"))
    f = rows.select(F.explode("files").alias("f")).select("f.*")
    return f.select(F.col("artifactKey").alias("key"), "sha256", F.col("byteSize").alias("bytes"), F.col("sourceId").alias("source"), F.coalesce("sourceRevision", F.lit("unknown")).alias("revision"))


def listed(manifest: DataFrame, source: str, prefix: str = "") -> DataFrame:
    """The artifacts of one source whose keys begin with prefix."""
    return manifest.where((F.col("source") == source) & F.col("key").startswith(prefix))


def write_json(report: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """A report as JSON lines, in a folder per value of `by`; what was there before goes."""
    report.write.mode("overwrite").partitionBy(*by).json(path)


def write_csv(report: DataFrame, path: str) -> None:
    """A flat report as CSV with its nine columns and a header."""
    report.select(*REPORT_COLUMNS).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
