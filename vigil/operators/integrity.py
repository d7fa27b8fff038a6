"""Foreign keys as a table of edges: rows that point nowhere, and what deleting rows takes with it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.snapshots import written
from .tables import orphans


@dataclass(frozen=True)
class Edge:
    """child.foreign points at parent.key; on_delete is cascade, set null or restrict."""

    child: str
    foreign: str
    parent: str
    key: str = "id"
    on_delete: str = "restrict"


# The tables' foreign keys and what a delete does.
EDGES = (
    Edge("ingest_cursors", "channel_id", "channels"), Edge("raw_messages", "channel_id", "channels"),
    Edge("parsed_events", "raw_message_id", "raw_messages"), Edge("parse_attempts", "raw_message_id", "raw_messages"),
    Edge("event_locations", "parsed_event_id", "parsed_events", on_delete="cascade"), Edge("event_locations", "region_id", "regions"), Edge("event_locations", "place_id", "places"),
    Edge("places", "region_id", "regions"), Edge("places", "parent_place_id", "places"), Edge("regions", "geometry_artifact_key", "geo_dataset_file", "artifact_key"), Edge("places", "geometry_artifact_key", "geo_dataset_file", "artifact_key"),
    Edge("place_aliases", "region_id", "regions"), Edge("place_aliases", "place_id", "places"), Edge("place_cache", "region_id", "regions", on_delete="set null"), Edge("place_cache", "place_id", "places", on_delete="set null"),
    Edge("place_status", "place_id", "places", on_delete="cascade"), Edge("place_status_history", "place_id", "places", on_delete="cascade"), Edge("place_evidence", "place_id", "places", on_delete="cascade"),
    Edge("place_status", "status_code", "status_dictionary", "code"), Edge("place_status_history", "status_code", "status_dictionary", "code"),
)
# End of fixed values.


def _union(frames: list[DataFrame], like: str, spark) -> DataFrame:
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], like)


def row_names(tables: dict[str, DataFrame], edges: tuple[Edge, ...], row: str) -> dict[str, str]:
    """The column that names a table's rows: `row`, or the key that edges point at where a table has no such column."""
    return {t: row if row in df.columns else next(e.key for e in edges if e.parent == t) for t, df in tables.items()}


def dangling(tables: dict[str, DataFrame], edges: tuple[Edge, ...] = EDGES, row: str = "id") -> DataFrame:
    """(tbl, row, column): rows whose foreign key is set and points at nothing, over all edges between the given tables."""
    names = row_names(tables, edges, row)
    found = [
        orphans(tables[e.child], e.foreign, tables[e.parent], e.key).select(F.lit(e.child).alias("tbl"), F.col(names[e.child]).cast("string").alias("row"), F.lit(e.foreign).alias("column"))
        for e in edges if e.child in tables and e.parent in tables
    ]
    return _union(found, "tbl string, row string, column string", next(iter(tables.values())).sparkSession)


def delete(tables: dict[str, DataFrame], doomed: dict[str, DataFrame], edges: tuple[Edge, ...] = EDGES, row: str = "id") -> DataFrame:
    """(tbl, row, effect) of deleting the doomed rows (tables of their row): delete, clear COLUMN, or block COLUMN.

    Rows that cascades reach are found by rounds: each joins the children of what the round before newly found, until nothing
    new comes; a chain of parents takes a round for each generation, a ring ends as its rows are known. clear: rows that stay
    and whose key is set null; block: rows that stay and whose key may not go - with any, the whole delete is to be refused.
    """
    spark = next(iter(tables.values())).sparkSession
    live = [e for e in edges if e.child in tables and e.parent in tables]
    cascades = [e for e in live if e.on_delete == "cascade"]
    key_type = "tbl string, row string"
    names = row_names(tables, edges, row)
    named = lambda t, df: df.select(F.lit(t).alias("tbl"), F.col(names[t]).cast("string").alias("row"))
    gone = new = written(_union([named(t, tables[t].join(rows.select(names[t]).distinct(), names[t], "left_semi")) for t, rows in doomed.items()], key_type, spark).distinct(), "gone")

    def pointing(e: Edge, at: DataFrame) -> DataFrame:
        """(tbl, row) of e's children whose parent is in `at` (tbl, row)."""
        hit = at.where(F.col("tbl") == e.parent).select(F.col("row").alias("_row"))
        parents = tables[e.parent].join(hit, F.col(names[e.parent]).cast("string") == F.col("_row"), "left_semi").select(F.col(e.key).alias(e.foreign))
        return named(e.child, tables[e.child].join(parents.distinct(), e.foreign, "left_semi"))

    while cascades and not new.isEmpty():
        new = written(_union([pointing(e, new) for e in cascades], key_type, spark).distinct().join(gone, ["tbl", "row"], "left_anti"), "newly")
        gone = gone.unionByName(new)
    gone = written(gone, "gone")
    verb = {"set null": "clear", "restrict": "block"}
    left = [pointing(e, gone).join(gone, ["tbl", "row"], "left_anti").withColumn("effect", F.lit(f"{verb[e.on_delete]} {e.foreign}")) for e in live if e.on_delete in verb]
    return _union([gone.withColumn("effect", F.lit("delete")), *left], key_type + ", effect string", spark)
