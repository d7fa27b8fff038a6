"""Queries over the files of source snapshots, which are written out of the given tables and read back; DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import dialects, geojson
from ..sources.snapshots import fresh_path
from .domain import _NORM, _t

_FEATURE = lambda props: F.concat(F.lit(',{"type":"Feature","properties":'), F.to_json(F.struct(*props)), F.lit(',"geometry":{"type":"Point","coordinates":[1.5,2]}}'))


def _written(rows: DataFrame, line: Column, first: Column, last: Column | None, path: str) -> None:
    """Text files, one for each value of `part`: a first line, the lines in order of ord, a last one."""
    ends = rows.select("part").distinct()
    lines = rows.select("part", F.lit(1).alias("_s"), "ord", line.alias("value")).unionByName(ends.select("part", F.lit(0).alias("_s"), F.lit(0).cast("long").alias("ord"), first.alias("value")))
    if last is not None:
        lines = lines.unionByName(ends.select("part", F.lit(2).alias("_s"), F.lit(0).cast("long").alias("ord"), last.alias("value")))
    lines.repartition("part").sortWithinPartitions("part", "_s", "ord").select("part", "value").write.partitionBy("part").text(path)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "layers")
    begin, end = F.lit('{"type":"FeatureCollection","bbox":[0,1],"features":[{"type":"Feature","properties":null}'), F.lit('],"name":"x"}')
    nation = _t(spark, sf_dir, "nation").selectExpr("n_regionkey AS part", "CAST(n_nationkey AS BIGINT) AS ord", "n_name")
    _written(nation, _FEATURE([F.when(F.col("ord") % 2 == 0, F.col("n_name")).alias("region"), F.concat(F.lit(" "), "n_name").alias("title"), F.col("ord").alias("name")]), begin, end, f"{path}/Countries")
    town = _t(spark, sf_dir, "customer").selectExpr("c_nationkey AS part", "c_custkey AS ord", "c_name", "c_mktsegment")
    props = [F.when(F.col("ord") % 3 != 0, F.col("c_name")).alias("district"), F.when(F.col("ord") % 5 != 0, F.concat(F.lit("N-"), F.col("part").cast("string"))).alias("region"), F.when(F.col("ord") % 7 != 0, F.col("c_mktsegment")).alias("name"), F.col("c_mktsegment").alias("Federal District")]
    _written(town, _FEATURE(props), begin, end, f"{path}/Cities")
    return geojson.read_features(spark, path, suffixes=".txt")


def osm_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geojson.osm_drafts(_features(spark, sf_dir))[1].select("region_code", "kind", "name", "layer", "district")


def osm_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geojson.osm_drafts(_features(spark, sf_dir))[0].select("iso", "name", "name_with_type")


def osm_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geojson.osm_drafts(_features(spark, sf_dir))[2]


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    path, rows = fresh_path(spark, "tables"), _t(spark, sf_dir, "customer").selectExpr("c_nationkey AS part", "c_custkey AS ord", "c_name", "c_mktsegment")
    fias = F.when(F.col("ord") % 4 != 0, F.concat(F.lit("f"), F.col("ord").cast("string"))).otherwise("")
    typed = F.when(F.col("ord") % 3 == 0, F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")"))).when(F.col("ord") % 3 == 1, F.upper("c_name")).otherwise("")
    _written(rows.where("part % 2 = 0"), F.concat_ws(";", fias, F.lit("x"), "c_name", typed), F.lit("made by hand, or so\n\nFIAS ID;okato;Name;name with type"), None, f"{path}/a")
    _written(rows.where("part % 2 = 1"), F.concat_ws(",", "c_name", fias), F.lit("name,fias_id"), None, f"{path}/b")
    regions = dialects.read_found(spark, path, dialects.REGION_COLUMNS, ("name",), "*.txt")
    return regions, dialects.region_drafts(spark, path, "*.txt")[1]


def found_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of tables in two dialects; a header may stand below other lines."""
    return _tables(spark, sf_dir)[0].select("name", F.col("fias id").alias("fias_id"), F.col("name with type").alias("name_with_type"), "okato")


def found_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir)[1].select("target_key", "alias")


_TOWNS = f"""WITH t AS (SELECT c_nationkey AS n, CASE WHEN c_custkey % 3 <> 0 THEN c_name WHEN c_custkey % 7 <> 0 THEN c_mktsegment WHEN c_custkey % 5 <> 0 THEN 'N-' || c_nationkey ELSE c_mktsegment END AS name, c_mktsegment AS district,
 CASE WHEN c_custkey % 5 <> 0 THEN 'n ' || c_nationkey ELSE 'unknown' END AS region_code FROM customer), r AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE n_name END AS name, {_NORM('n_name')} AS iso FROM nation)"""
_TABLES = """WITH c AS (SELECT c_name AS name, CASE WHEN c_custkey % 4 <> 0 THEN 'f' || c_custkey END AS fias_id, CASE WHEN c_nationkey % 2 = 0 THEN 'x' END AS okato,
 CASE WHEN c_nationkey % 2 = 0 THEN CASE c_custkey % 3 WHEN 0 THEN c_name || ' (' || c_mktsegment || ')' WHEN 1 THEN upper(c_name) END END AS name_with_type FROM customer)"""

QUERIES = {"osm_regions": osm_regions, "osm_places": osm_places, "osm_aliases": osm_aliases, "found_tables": found_tables, "found_aliases": found_aliases}

ORACLE = {
    "osm_regions": f"{_TOWNS} SELECT iso, name, name AS name_with_type FROM r",
    "osm_places": f"{_TOWNS} SELECT region_code, 'locality' AS kind, name, 'cities' AS layer, district FROM t",
    "osm_aliases": f"{_TOWNS} SELECT 'region' AS target_kind, iso AS target_key, name AS alias, 'auto' AS source FROM r UNION ALL SELECT 'place', region_code || ':locality:' || {_NORM('name')}, name, 'auto' FROM t",
    "found_tables": f"{_TABLES} SELECT name, fias_id, name_with_type, okato FROM c",
    "found_aliases": f"{_TABLES} SELECT coalesce(fias_id, {_NORM('name')}) AS target_key, unnest(CASE WHEN {_NORM('name')} <> {_NORM('name_with_type')} THEN [name, name_with_type] ELSE [name] END) AS alias FROM c",
}
