"""Match-or-create: candidates against known places by id, then alias, then name within the region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_geo, norm_lookup
from .tables import first_per_key


def cascade(candidates: DataFrame, places: DataFrame, aliases: DataFrame) -> DataFrame:
    """candidates with place_id and matched_by (fias, alias, name or null).

    candidates: fias_id, name, region_id; places: place_id, fias_id, region_id, name; aliases: place_id, alias_norm, ord.
    Three equi-joins, each on a table with one row per key; ties go to the smallest place id (aliases: the first).
    """
    by_fias = first_per_key(places.where("fias_id is not null").select("fias_id", F.col("place_id").alias("_f")), ["fias_id"], ["_f"])
    by_alias = first_per_key(aliases.where("place_id is not null").select("alias_norm", F.col("place_id").alias("_a"), "ord"), ["alias_norm"], ["ord", "_a"]).drop("ord")
    by_name = first_per_key(places.select("region_id", norm_geo(F.col("name")).alias("_norm"), F.col("place_id").alias("_n")), ["region_id", "_norm"], ["_n"])
    rows = candidates.withColumn("alias_norm", norm_lookup(F.col("name"))).withColumn("_norm", norm_geo(F.col("name")))
    found = rows.join(by_fias, "fias_id", "left").join(by_alias, "alias_norm", "left").join(by_name, ["region_id", "_norm"], "left")
    by = F.when(F.col("_f").isNotNull(), "fias").when(F.col("_a").isNotNull(), "alias").when(F.col("_n").isNotNull(), "name")
    return found.withColumn("place_id", F.coalesce("_f", "_a", "_n")).withColumn("matched_by", by).drop("_f", "_a", "_n", "_norm", "alias_norm")


def decide(matched: DataFrame) -> DataFrame:
    """matched with decision: rejected without region or name, matched, created at the first candidate of a new place, then matched."""
    from pyspark.sql import Window

    new = F.coalesce(F.col("fias_id"), F.concat_ws(":", "region_id", norm_geo(F.col("name"))))
    valid = F.col("region_id").isNotNull() & (F.coalesce("name", F.lit("")) != "")
    rank = F.row_number().over(Window.partitionBy(F.col("place_id").isNull(), valid, new).orderBy("seq"))
    decision = F.when(~valid, "rejected").when(F.col("place_id").isNotNull(), "matched").when(rank == 1, "created").otherwise("matched")
    return matched.withColumn("decision", decision)


def tallies(decided: DataFrame, message: str) -> DataFrame:
    """(message, known, created, rejected, has_accepted): decisions of each message's places, and whether any was accepted."""
    n = lambda v: F.count(F.when(F.col("decision").isin(*v), 1))
    known, created = ("matched", "matched_existing"), ("created", "created_new")
    accepted = F.coalesce(F.bool_or(F.col("decision").isin(*known, *created)), F.lit(False))
    return decided.groupBy(message).agg(n(known).alias("known"), n(created).alias("created"), n(("rejected",)).alias("rejected"), accepted.alias("has_accepted"))


def message_totals(tallied: DataFrame) -> DataFrame:
    """One row over messages: places by decision, messages with an accepted place and without."""
    accepted = F.col("has_accepted")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("known", "created", "rejected")]
    return tallied.agg(F.count(F.lit(1)).alias("messages"), *sums, F.count(F.when(accepted, 1)).alias("accepted"), F.count(F.when(~accepted, 1)).alias("none_accepted"))


def decide_api(matched: DataFrame, fallback: str) -> DataFrame:
    """matched with decision and cached, as the service decides: a place that is found needs no name, and each verdict has its own
    cache write (plain, validated, or none). matched's region_id is the candidate's or the fallback column's.

    Rejected without a region (cached plain); matched_existing (plain); without a name rejected (not cached); created_new at
    the first candidate of a new place (validated), which later ones then match.
    """
    from pyspark.sql import Window

    region = F.coalesce("region_id", fallback)
    new = F.coalesce(F.nullif(F.col("fias_id"), F.lit("")), F.concat_ws(":", region, norm_geo(F.col("name"))))
    named = F.coalesce("name", F.lit("")) != ""
    open_ = region.isNotNull() & F.col("place_id").isNull() & named
    rank = F.row_number().over(Window.partitionBy(open_, new).orderBy("seq"))
    decision = F.when(region.isNull(), "rejected").when(F.col("place_id").isNotNull(), "matched_existing").when(~named, "rejected").when(rank == 1, "created_new").otherwise("matched_existing")
    cached = F.when(F.col("decision") == "created_new", "validated").when((F.col("decision") == "rejected") & region.isNotNull(), "none").otherwise("plain")
    return matched.withColumn("decision", decision).withColumn("cached", cached)
