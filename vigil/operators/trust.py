"""Trust of places: policy, and the fold of ordered contributions as windows instead of a sequential loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Score of a provider without one of its own, providers trusted as such, states in rising order.
PROVIDER_SCORE = {"catalog": 1.0, "dadata": 0.95, "nominatim": 0.8, "llm": 0.55, "operator": 1.0, "system": 0.7}
TRUSTED = ("catalog", "dadata", "operator", "system")
STATES = ("rejected", "unverified", "partially_verified", "verified")
SOURCE_PROVIDER = {"db": "catalog", "cache": "system"}
FIELDS = ("name", "name_with_type", "kind", "parent_place_id", "fias_id", "kladr_id", "oktmo", "geometry_artifact_key", "centroid_lat", "centroid_lon", "bbox")
# End of fixed values.


def provider_of(source: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in SOURCE_PROVIDER.items() for x in kv))
    return F.coalesce(F.element_at(known, source), source)


def score_of(provider: Column, confidence: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in PROVIDER_SCORE.items() for x in kv))
    return F.coalesce(confidence, F.element_at(known, provider))


def is_trusted(provider: Column, score: Column) -> Column:
    return provider.isin(*TRUSTED) | (score >= 0.9)


def state_of(trusted: Column, score: Column) -> Column:
    return F.when(trusted, "verified").when(score >= 0.7, "partially_verified").otherwise("unverified")


def needs_attention(trusted: Column, state: Column) -> Column:
    return ~trusted | (state == "unverified")


def _rank(state: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in STATES)), state)


def accepted(contributions: DataFrame, place: str = "place_id", seq: str = "seq") -> DataFrame:
    """contributions with accepted: whether the score is at least every earlier one's. One reducer per place, rows in order."""
    before = Window.partitionBy(place).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return contributions.withColumn("accepted", F.coalesce("score", F.lit(0)) >= F.coalesce(F.max(F.coalesce("score", F.lit(0))).over(before), F.lit(0)))


def fold(contributions: DataFrame, fields: tuple[str, ...], place: str = "place_id", seq: str = "seq") -> DataFrame:
    """What the contributions of each place, merged in order, end up as.

    A field is its last accepted value, else its first; the score and state are the highest, trust stays once given;
    providers are kept in order of first appearance. Empty strings are values, nulls are not.
    """
    rows = accepted(contributions, place, seq)
    value = lambda c: F.coalesce(
        F.max_by(c, F.when(F.col("accepted") & F.col(c).isNotNull(), F.col(seq))), F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq)))
    ).alias(c)
    return rows.groupBy(place).agg(
        *(value(c) for c in fields),
        F.max("score").alias("score"),
        F.bool_or("is_trusted").alias("is_trusted"),
        F.max_by("state", _rank(F.col("state"))).alias("state"),
        F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(seq, "provider"))), lambda x: x["provider"])), ",").alias("providers"),
        F.count(F.lit(1)).alias("n"),
    )


def applied_fields(contributions: DataFrame, fields: tuple[str, ...], place: str = "place_id", seq: str = "seq") -> DataFrame:
    """Per contribution: which fields it changed, and the evidence action that follows (enrich where any, else confirm)."""
    rows = accepted(contributions, place, seq)
    before = Window.partitionBy(place).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    # a value is the current one after its row if it was accepted or nothing was there
    out = rows
    for c in fields:
        first = F.count(F.col(c)).over(before) == 0
        out = out.withColumn(f"_set_{c}", F.when(F.col(c).isNotNull() & (F.col("accepted") | first), F.col(c)))
    for c in fields:
        out = out.withColumn(f"_was_{c}", F.last(f"_set_{c}", ignorenulls=True).over(before))
    changed = F.array_compact(F.array(*(F.when(F.col(f"_set_{c}").isNotNull() & ~F.col(f"_set_{c}").eqNullSafe(F.col(f"_was_{c}")), c) for c in fields)))
    return out.select(place, seq, F.array_join(changed, ",").alias("applied"), F.when(F.size(changed) > 0, "enrich").otherwise("confirm").alias("action"))


def summary(contributions: DataFrame, fields: tuple[str, ...], place: str = "place_id", seq: str = "seq", chunk: Column | None = None) -> DataFrame:
    """What the contributions of each place come to before it is known what stood there: one row per place and chunk, mergeable.

    Of a field: the first value, and the last one that no earlier score of the chunk beats, with its score. Accepted scores
    only rise, so that value stands if its score is at least all scores before the chunk, and if it doesn't, no earlier one
    does. chunk: a number that rises with seq, say floor(seq / 10000), so that one place's rows are shared out over tasks.
    """
    rows = contributions.withColumn("_c", (F.lit(0) if chunk is None else chunk).cast("long")).withColumn("_s", F.coalesce("score", F.lit(0.0)))
    before = Window.partitionBy(place, "_c").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_stands", F.col("_s") >= F.coalesce(F.max("_s").over(before), F.lit(0.0)))
    last = lambda c: F.max_by(F.struct("_s", F.col(c).alias("v")), F.when(F.col("_stands") & F.col(c).isNotNull(), F.col(seq))).alias(f"_last_{c}")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"_first_{c}")
    folded = rows.groupBy(place, "_c").agg(
        *(last(c) for c in fields), *(first(c) for c in fields), F.max("score").alias("score"), F.bool_or("is_trusted").alias("is_trusted"),
        F.max_by("state", _rank(F.col("state"))).alias("state"), F.count(F.lit(1)).alias("n"),
    )
    providers = rows.where("provider is not null").groupBy(place, "_c", "provider").agg(F.min(seq).alias("_f")).groupBy(place, "_c")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_f", "provider"))), lambda x: x["provider"])
    return folded.join(providers.agg(ordered.alias("providers")), [place, "_c"], "left")


def as_summary(stored: DataFrame, fields: tuple[str, ...], place: str = "place_id") -> DataFrame:
    """Stored places as the summary of all that they were merged from; it precedes every chunk."""
    value = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.coalesce("score", F.lit(0.0)).alias("_s"), F.col(c).alias("v"))).alias(f"_last_{c}")
    return stored.select(place, F.lit(-1).cast("long").alias("_c"), *(value(c) for c in fields), *(F.col(c).alias(f"_first_{c}") for c in fields), "score", "is_trusted", "state", "n", "providers")


def combine(summaries: DataFrame, fields: tuple[str, ...], place: str = "place_id") -> DataFrame:
    """One row per place out of its summaries, in order of their chunks: what a fold of all their contributions gives."""
    before = Window.partitionBy(place).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    rows = summaries.withColumn("_above", F.coalesce(F.max("score").over(before), F.lit(0.0)))
    value = lambda c: F.coalesce(
        F.max_by(f"_last_{c}.v", F.when(F.col(f"_last_{c}._s") >= F.col("_above"), F.col("_c"))), F.min_by(f"_first_{c}", F.when(F.col(f"_first_{c}").isNotNull(), F.col("_c")))
    ).alias(c)
    lists = F.transform(F.array_sort(F.collect_list(F.struct("_c", "providers"))), lambda x: F.coalesce(x["providers"], F.array().cast("array<string>")))
    return rows.groupBy(place).agg(
        *(value(c) for c in fields), F.max("score").alias("score"), F.coalesce(F.bool_or("is_trusted"), F.lit(False)).alias("is_trusted"),
        F.max_by("state", _rank(F.col("state"))).alias("state"), F.array_distinct(F.flatten(lists)).alias("providers"), F.sum("n").alias("n"),
    )


def fold_onto(stored: DataFrame, batch: DataFrame, fields: tuple[str, ...] = FIELDS, place: str = "place_id", seq: str = "seq", chunk: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(places, missing): a batch of contributions merged into stored places without the contributions that made them.

    stored: place, fields, score, is_trusted, state, providers (array), n; places: the same and applied, the names of what the
    batch changed in fixed order. missing: (place, n) of contributions to places that are not stored; they change nothing.
    """
    known = batch.join(stored.select(place), place, "left_semi")
    merged = combine(as_summary(stored, fields, place).unionByName(summary(known, fields, place, seq, chunk)), fields, place)
    compared = {**{c: c for c in fields}, "trust_state": "state", "is_trusted": "is_trusted", "trust_score": "score", "evidence_providers": "providers"}
    was = stored.select(place, F.struct(*dict.fromkeys(compared.values())).alias("_was"))
    changed = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_was.{c}")), name) for name, c in compared.items())))
    stamped = F.when(F.size("_ch") > 0, F.array_append("_ch", F.lit("trust_updated_at"))).otherwise(F.col("_ch"))
    out = merged.join(was, place).withColumn("_ch", changed).withColumn("applied", F.array_join(stamped, ",")).drop("_was", "_ch")
    return out, batch.join(stored.select(place), place, "left_anti").groupBy(place).agg(F.count(F.lit(1)).alias("n"))
