"""Reference-data sync: draft keys, first-wins union of sources, snapshot diff, key indices and links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_geo
from .tables import first_per_key


def region_key(fias: Column, iso: Column, name: Column) -> Column:
    """The first id that isn't null, else the name; an empty string counts as an id."""
    return F.coalesce(fias, iso, norm_geo(name))


def place_key(fias: Column, region: Column, kind: Column, name: Column) -> Column:
    return F.coalesce(fias, F.concat(region, F.lit(":"), kind, F.lit(":"), norm_geo(name)))


def composite(sources: list[DataFrame], key: str, order: str) -> DataFrame:
    """All sources' rows, of equal keys only the first source's first."""
    numbered = [s.withColumn("source_ord", F.lit(i)) for i, s in enumerate(sources)]
    return first_per_key(reduce(DataFrame.unionByName, numbered), [key], ["source_ord", order])


def diff(expected: DataFrame, current: DataFrame, key: str, order: str, compared: tuple[str, ...]) -> DataFrame:
    """Each expected row with change added, updated or noop against the last current row of its key; null equals an empty string."""
    last = first_per_key(current, [key], [F.desc(order)])
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    seen = last.select(F.col(key), *(text(c).alias(f"_was_{c}") for c in compared), F.lit(True).alias("_seen"))
    same = reduce(lambda a, b: a & b, (text(c) == F.col(f"_was_{c}") for c in compared))
    change = F.when(F.col("_seen").isNull(), "added").when(same, "noop").otherwise("updated")
    return expected.join(seen, key, "left").withColumn("change", change).drop("_seen", *(f"_was_{c}" for c in compared))


def removed(expected: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Current rows whose key is expected no longer."""
    return current.join(expected.select(key), key, "left_anti")


def key_index(rows: DataFrame, target: str, keys: list[Column], order: str) -> DataFrame:
    """(key, target): every key under which a row can be found; the last row of a key wins."""
    every = rows.select(target, order, F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("key"))
    return first_per_key(every, ["key"], [F.desc(order)]).select("key", target)


def resolve_key(rows: DataFrame, index: DataFrame, key: str, target: str) -> DataFrame:
    """rows with target: what the index (key, target) has for the key as it is, else for its normalised form."""
    exact = index.select(F.col("key").alias(key), F.col("target").alias("_exact"))
    normal = index.select(F.col("key").alias("_norm"), F.col("target").alias("_normal"))
    found = rows.withColumn("_norm", norm_geo(F.col(key))).join(exact, key, "left").join(normal, "_norm", "left")
    return found.withColumn(target, F.coalesce("_exact", "_normal")).drop("_norm", "_exact", "_normal")


def region_by_any_key(codes: DataFrame, code: str, regions: DataFrame, keys: tuple[str, ...], target: str = "region_id") -> DataFrame:
    """codes with the smallest target whose any of the keys equals the code: keys become rows, so that one equi-join does."""
    rows = regions.select(target, F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias(code)).groupBy(code).agg(F.min(target).alias(target))
    return codes.join(rows, code, "left")


def link_places(drafts: DataFrame, places: DataFrame) -> DataFrame:
    """(draft_key, place_id) of drafts that a stored place answers to; of equal keys the last draft's.

    drafts: ord, fias_id, region_code, region_id (resolved), kind, name; places: place_id, fias_id, region_id, kind, name, in
    order of place_id. A draft with an id is looked up by it alone, others by region, kind and normalised name.
    """
    has = F.coalesce(F.col("fias_id"), F.lit("")) != ""
    natural = F.concat_ws(":", "region_id", "kind", norm_geo(F.col("name")))
    by_fias = places.where(has).groupBy("fias_id").agg(F.max("place_id").alias("_f"))
    by_name = places.select(natural.alias("_natural"), "place_id").groupBy("_natural").agg(F.max("place_id").alias("_n"))
    rows = drafts.where("region_id is not null").withColumn("_natural", natural).join(by_fias, "fias_id", "left").join(by_name, "_natural", "left")
    found = rows.withColumn("place_id", F.when(has, F.col("_f")).otherwise(F.col("_n"))).where("place_id is not null")
    key = place_key(F.col("fias_id"), F.col("region_code"), F.col("kind"), F.col("name"))
    return found.groupBy(key.alias("draft_key")).agg(F.max_by("place_id", "ord").alias("place_id"))


def alias_rows(aliases: DataFrame, drafts: DataFrame, regions: DataFrame, links: DataFrame) -> DataFrame:
    """(target_kind, region_id, place_id, alias, alias_norm, source) of the providers' aliases and of the names of linked drafts.

    aliases: target_kind, target_key, alias, source; drafts: as for link_places, and names array<string>; regions: an index
    (key, target); links: draft_key, place_id. Aliases without letters or digits, or without a target, are left out.
    """
    key = place_key(F.col("fias_id"), F.col("region_code"), F.col("kind"), F.col("name"))
    own = drafts.select(F.lit("place").alias("target_kind"), key.alias("target_key"), F.explode(F.array_compact("names")).alias("alias"), F.lit("auto").alias("source"))
    every = aliases.select("target_kind", "target_key", "alias", "source").unionByName(own).withColumn("alias_norm", norm_geo(F.col("alias"))).where("alias_norm <> ''")
    of_region = resolve_key(every.where("target_kind = 'region'"), regions, "target_key", "region_id").where("region_id is not null")
    of_place = every.where("target_kind = 'place'").join(links.withColumnRenamed("draft_key", "target_key"), "target_key")
    out = of_region.withColumn("place_id", F.lit(None).cast(links.schema["place_id"].dataType)).unionByName(of_place.withColumn("region_id", F.lit(None).cast(regions.schema["target"].dataType)))
    return out.select("target_kind", "region_id", "place_id", "alias", "alias_norm", "source")


def changes(diffed: DataFrame, order: str, n: int = 20) -> DataFrame:
    """The first n rows that are added or updated, in the order of the input: the sample that a plan shows."""
    return diffed.where("change <> 'noop'").orderBy(order).limit(n)
