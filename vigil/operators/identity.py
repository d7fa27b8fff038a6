"""Entities with several identities: rows that share any key are one, and batches are laid over stored rows by that.

A key is a kind and a value, say an official id, a code and a name. Keys become rows, each key ties its rows to the smallest
of them, and rounds of smallest labels find which rows hang together; no task gathers the rows of a key or of an entity, and
the driver no side of a join, as all of them grow with the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_geo
from ..sources.snapshots import written
from .graph import components


def key_rows(rows: DataFrame, row: str, keys: dict[str, list[Column]]) -> DataFrame:
    """(row, key): every identity of every row. keys: the parts of each kind; a part that is null or empty leaves the kind out.

    Parts keep their lengths in the key, so that no two lists of parts are one key.
    """
    one = lambda kind, parts: F.when(
        reduce(lambda a, b: a & b, (F.coalesce(p.cast("string"), F.lit("")) != "" for p in parts)),
        F.concat(F.lit(f"{kind}="), *(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")) for p in parts)),
    )
    return rows.select(row, F.explode(F.array_distinct(F.array_compact(F.array(*(one(k, p) for k, p in keys.items()))))).alias("key"))


def entities(rows: DataFrame, row: str, keys: dict[str, list[Column]]) -> DataFrame:
    """(row, entity): the smallest row number that shares keys with the row, directly or through others."""
    tied = written(key_rows(rows, row, keys), "keys")
    first = tied.groupBy("key").agg(F.min(row).alias("b"))
    roots = components(tied.join(first.hint("merge"), "key").where(F.col(row) != F.col("b")).select(F.col(row).alias("a"), "b"))
    return rows.select(row).join(roots.select(F.col("id").alias(row), "root").hint("merge"), row, "left").select(row, F.coalesce("root", row).alias("entity"))


def upsert_entities(stored: DataFrame, batch: DataFrame, keys: dict[str, list[Column]], order: str, fill: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(table, conflicts): the batch laid over the stored rows by any of the keys.

    stored: id and the columns of the table; batch: the same and `order`, a number of its own for each row. An entity keeps
    the smallest id of its stored rows; a new one takes the id of its first batch row. Its columns are those of its last batch
    row, nulls included; for columns in `fill` the last one that is not null, the stored value of the kept row at worst. Stored
    rows that the batch does not reach stay as they are, even if they share a key among themselves. conflicts: (id, other_id)
    for each further stored row that the batch turned out to be one entity with the kept one; the table leaves it out. Ids
    are unique in stored; a null id in the batch is a new entity's id only if no stored row has one.
    """
    names = [c for c in stored.columns if c != "id"]
    old = stored.select(F.struct(F.lit(0).alias("late"), F.lit(None).cast(batch.schema[order].dataType).alias("at"), F.col("id").alias("was")).alias("_r"), "id", *names)
    new = batch.select(F.struct(F.lit(1).alias("late"), F.col(order).alias("at"), F.lit(None).cast(stored.schema["id"].dataType).alias("was")).alias("_r"), "id", *names)
    rows = written(old.unionByName(new), "rows")  # the row number: stored ones first, in order of id, then the batch in its order
    of = entities(rows, "_r", keys)
    labelled = written(rows.join(of.hint("merge"), "_r"), "labelled")
    late = F.col("_r.late") == 1
    value = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_o"))) if c in fill else F.max_by(F.struct(c), F.col("_o"))[c]
    kept_id = F.coalesce(F.min(F.when(~late, F.col("id"))), F.min_by("id", F.when(late, F.col("_r"))))
    reached = labelled.groupBy("entity").agg(F.max("_r.late").alias("_late"), kept_id.alias("_id")).where("_late = 1")
    touched = labelled.join(reached.select("entity", "_id").hint("merge"), "entity")
    # of the stored rows only the kept one has a say, below all of the batch
    says = touched.where(late | (F.col("id") == F.col("_id"))).withColumn("_o", F.col("_r"))
    merged = says.groupBy("entity", "_id").agg(*(value(c).alias(c) for c in names)).select(F.col("_id").alias("id"), *names)
    alone = labelled.join(reached.select("entity").hint("merge"), "entity", "left_anti").select("id", *names)
    conflicts = touched.where(~late & (F.col("id") != F.col("_id"))).select(F.col("_id").alias("id"), F.col("id").alias("other_id"))
    return merged.unionByName(alone), conflicts


def region_keys() -> dict[str, list[Column]]:
    """A region is known by its official id, its ISO code (else any code) or its name, as they are written."""
    return {"fias": [F.col("fias_id")], "iso": [F.coalesce("iso", "code")], "name": [F.col("name")]}


def place_keys() -> dict[str, list[Column]]:
    """A place is known by its official id, or by region, kind and normalised name together."""
    return {"fias": [F.col("fias_id")], "natural": [F.col("region_id"), F.col("kind"), norm_geo(F.col("name"))]}
