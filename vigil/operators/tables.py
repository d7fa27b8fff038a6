"""Keyed tables as snapshots: latest and first rows per key, upserts, replacement of children, top rows per key, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in the given order; a window limit prunes rows before the shuffle."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def top_per_key(rows: DataFrame, key: list[str], order: list[str | Column], n: int) -> DataFrame:
    w = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("rank", w.cast("int")).where(F.col("rank") <= n)


def upsert(base: DataFrame, updates: DataFrame, key: list[str], order: list[str | Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """base with the last update of each key laid over it; columns in `keep` stay as they were where the key was there.

    Both sides have the same columns; a null in an update replaces the value.
    """
    last = first_per_key(updates, key, order)
    names = [c for c in base.columns if c not in key]
    b, u = base.select(*key, F.struct(*names).alias("_b")), last.select(*key, F.struct(*names).alias("_u"))
    pick = lambda c: F.when(F.col("_b").isNotNull() & (F.col("_u").isNull() | F.lit(c in keep)), F.col(f"_b.{c}")).otherwise(F.col(f"_u.{c}"))
    return b.join(u, key, "full_outer").select(*key, *(pick(c).alias(c) for c in names))


def replace_children(children: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """children without those of any parent in fresh, and fresh."""
    return children.join(fresh.select(parent).distinct(), parent, "left_anti").unionByName(fresh)


def insert_missing(base: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """base and those rows whose key it lacks."""
    return base.unionByName(rows.join(base.select(*key), key, "left_anti"))


def orphans(child: DataFrame, foreign: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose foreign key is set but not in parent."""
    return child.where(F.col(foreign).isNotNull()).join(parent.select(F.col(key).alias(foreign)), foreign, "left_anti")


def where_given(rows: DataFrame, **params: object) -> DataFrame:
    """Rows that equal all given parameters; None doesn't constrain."""
    for name, value in params.items():
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    return rows


def active(rows: DataFrame) -> DataFrame:
    """Rows that are in use; the filter reaches the scan."""
    return rows.where(F.col("is_active"))


def delete_keys(base: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """base without the rows of these keys, as a status that ends loses its row."""
    return base.join(keys.select(*key).distinct(), key, "left_anti")


def upsert_aliases(base: DataFrame, updates: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """base with the last update of each alias laid over it; an alias that was retired comes back.

    base: key, alias, source, is_active, deprecated_at; updates: key, alias, source and what order needs.
    """
    last = first_per_key(updates, key, order).select(*key, F.col("alias").alias("_alias"), F.col("source").alias("_source"), F.lit(True).alias("_new"))
    new = lambda c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return base.join(last, key, "full_outer").select(
        *key, new("alias"), new("source"), F.coalesce("_new", "is_active").alias("is_active"), F.when(F.col("_new").isNull(), F.col("deprecated_at")).alias("deprecated_at")
    )


def finish(base: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Started runs with the status and end of those that results name; results of unknown runs are ignored."""
    done = results.select(key, F.col("status").alias("_status"), F.col("finished_at").alias("_end"))
    return base.join(done, key, "left").withColumn("status", F.coalesce("_status", "status")).withColumn("finished_at", F.coalesce("_end", "finished_at")).drop("_status", "_end")


def of_parents(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """The children of the given parents."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def limit_of(value: object, default: int) -> int:
    """A row limit out of a request parameter: the default where it isn't a finite number."""
    try:
        n = float(default if value is None else value)
        return int(n) if abs(n) != float("inf") and n == n else default
    except (TypeError, ValueError):
        return default
