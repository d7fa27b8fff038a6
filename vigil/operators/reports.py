"""Reports over classified posts: summaries, gap analysis, flat records, and file sinks.

What was found in posts joins them by sorted partitions: it grows with them, and is small on disk only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_geo, preview
from ..functions.text import tidy as tidy_text
from . import merge

# What looks like a mention of a region. Its last word ends where a Latin letter, digit or underscore begins or ends.
REGION_LIKE_SQL = r"(?i)(област|край|республик|респ\.|обл\.|ао[A-Za-z0-9_])"
REGION_LIKE = r"(?iu)(област|край|республик|респ\.|обл\.|ао(?=[A-Za-z0-9_]))"
# End of fixed values.
MENTION_CHARS = 120


def kind_counts(classified: DataFrame, *by: str) -> DataFrame:
    """Rows by kind and the share of events, rounded to 4 places; 0 where there are no rows."""
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    out = classified.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), n("event").alias("events"), n("noise").alias("noise"), n("meta").alias("meta"))
    share = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.round(F.col("events") / F.greatest(F.col("total"), F.lit(1)), 4))
    return out.withColumn("event_share", share)


def message_hash(channel: Column, message_id: Column, edit_date: Column) -> Column:
    """sha256 of compact JSON with the channel, message and edit date (null where never edited)."""
    return F.sha2(F.to_json(F.struct(channel.alias("c"), message_id.alias("m"), edit_date.alias("e")), {"ignoreNullFields": "false"}), 256)


def region_mentions(text: Column) -> Column:
    """Parts of a text, then whole short lines, that look like mentions of regions; each once, in order."""
    tidy = lambda arr: F.filter(F.transform(arr, tidy_text), lambda x: (x != "") & x.rlike(REGION_LIKE))
    lines = F.filter(tidy(F.split(text, "\n")), lambda x: F.length(x) <= MENTION_CHARS)
    return F.array_distinct(F.concat(tidy(F.split(text, "[\n,;|]+")), lines))


def _mentioning(rows: DataFrame, text: str, when: Column | None = None) -> DataFrame:
    """rows with _mentions, of those that are asked for only. It comes out of an array of one row, so that what uses it, filters
    too, does not find the mentions anew."""
    found = F.when(F.col(text).rlike(REGION_LIKE) if when is None else when & F.col(text).rlike(REGION_LIKE), region_mentions(F.col(text)))
    return rows.select("*", F.inline(F.array(F.struct(F.coalesce(found, F.array().cast("array<string>")).alias("_mentions")))))


def lost_mentions(posts: DataFrame, found: DataFrame, key: str = "post_id", text: str = "raw_text") -> DataFrame:
    """Mentions that neither contain nor are contained in any resolved name of their post."""
    names = found.groupBy(key).agg(F.collect_set(norm_geo(F.col("name"))).alias("_names"))
    mentions = _mentioning(posts.select(key, text), text).select(key, F.explode("_mentions").alias("mention")).withColumn("_m", norm_geo(F.col("mention")))
    known = F.exists(F.coalesce("_names", F.array().cast("array<string>")), lambda n: F.col("_m").contains(n) | n.contains(F.col("_m")))
    return mentions.join(names.hint("merge"), key, "left").where(~known).select(key, "mention")


def _counted(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def gap_totals(classified: DataFrame, found: DataFrame, places: DataFrame, key: str = "post_id") -> DataFrame:
    """One row of counts that show where parsing loses something. found: regions, places: places that posts were resolved to."""
    event, many = F.col("kind") == "event", F.size("_mentions") >= 2
    rows = _mentioning(classified, "raw_text", event)
    for part in (_counted(found, key, "_r"), _counted(places, key, "_p")):
        rows = rows.join(part.hint("merge"), key, "left")
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return rows.agg(
        F.count_distinct("channel_key").alias("files"), F.count(F.lit(1)).alias("blocks"), n(event, "event"), n(F.col("kind") == "noise", "noise"), n(F.col("kind") == "meta", "meta"),
        n(F.col("_r").isNull(), "unknown_geo"), n(event & F.col("_r").isNull(), "event_unknown_geo"), n(event & many, "multi_region_like"),
        n(event & many & (F.coalesce("_p", F.lit(0)) <= 1), "multi_region_collapsed"), n(F.col("reason") == "event_type_not_detected", "type_not_detected"),
    )


def gap_rows(classified: DataFrame, found: DataFrame, places: DataFrame, key: str = "post_id") -> DataFrame:
    """A row for each gap of each post: an event without regions, one that names several regions and has one place at most, a
    hint at an event of no known type. With the text, the numbers of regions and places, and lists, each once and sorted, of
    mentions, of the names that were resolved, and of the mentions that none of these answers."""
    event, many, r, p = F.col("kind") == "event", F.size("_mentions") >= 2, F.coalesce("_r", F.lit(0)), F.coalesce("_p", F.lit(0))
    issues = F.array_compact(
        F.array(
            F.when(event & (r == 0), "event_with_unknown_geo"), F.when(event & many & (p <= 1), "multi_region_collapsed_to_single_target"),
            F.when(F.col("reason") == "event_type_not_detected", "event_type_not_detected"),
        )
    )
    # each post once, with all that was found in it: regions and places are counted and named in one pass
    rows = _mentioning(classified, "raw_text", event | (F.col("reason") == "event_type_not_detected"))
    for part, n, names in ((found, "_r", "_rn"), (places, "_p", "_pn")):
        rows = rows.join(part.groupBy(key).agg(F.count(F.lit(1)).alias(n), F.collect_set("name").alias(names)).hint("merge"), key, "left")
    none = F.array().cast("array<string>")
    resolved = F.array_distinct(F.concat(F.coalesce("_rn", none), F.coalesce("_pn", none)))
    found_rows = rows.select("*", F.explode(issues).alias("issue")).select("*", resolved.alias("_names"))
    found_rows = found_rows.select("*", F.transform("_names", norm_geo).alias("_known"))
    told = lambda m: F.exists("_known", lambda n: m.contains(n) | n.contains(m))
    lost = F.filter("_mentions", lambda m: ~told(norm_geo(m)))
    listed = lambda c, out: F.array_join(F.sort_array(c), "|").alias(out)
    return found_rows.select(
        key, "issue", "event_type", preview(F.col("raw_text")).alias("preview"), "raw_text", r.alias("regions"), p.alias("places"),
        listed("_mentions", "mentions"), listed("_names", "resolved"), listed(lost, "lost"),
    )


def flat(classified: DataFrame, found: DataFrame, key: str = "post_id") -> DataFrame:
    """Nine flat columns per post: the first region, defaults for what is missing."""
    first = found.where("rank = 1").select(key, "code")
    rows = classified.join(first.hint("merge"), key, "left")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return rows.select(
        F.col(key).alias("index"), "kind", text("reason"), text("event_type"), text("severity"), F.coalesce("n", F.lit(0)).alias("count"),
        F.coalesce("code", F.lit("")).alias("region_code"), F.when(F.col("code").isNull(), "unknown").otherwise("region").alias("precision"), F.lit("local").alias("source"),
    )


# Providers in the order in which a report lists those that were tried.
TRIED = ("dadata", "nominatim", "llm")
# End of fixed values.


def nested(classified: DataFrame, regions: DataFrame, places: DataFrame, answers: DataFrame, key: str = "post_id", version: str = "0.1.0") -> DataFrame:
    """One nested report per post: raw, classification, event, geo, enrich, diagnostics.

    classified: key, raw_text, hash, channel_key, posted_at and what classify gives; regions: key, code, name; places: key,
    name, kind, region_code, lat, lon; answers: key, provider, cache_hit of the providers that were asked. What is no event
    has an empty geo and enrich and no event; places and regions are listed in order of their names, the smaller list of each
    post in one row.
    """
    spark_array = lambda rows, out: rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*(c for c in rows.columns if c != key)))).alias(out))
    listed_regions, listed_places = regions.select(key, "name", "code").distinct(), places.select(key, "name", "kind", "region_code", "lat", "lon").distinct()
    asked = answers.groupBy(key).agg(F.collect_set("provider").alias("_asked"), F.bool_or(F.coalesce("cache_hit", F.lit(False)) & F.col("provider").isin("dadata", "nominatim")).alias("_hit"))
    rows = classified
    for part in (spark_array(listed_regions, "_regions"), spark_array(listed_places, "_places"), asked):
        rows = rows.join(part.hint("merge"), key, "left")
    precision, completeness = merge.precision_of(F.col("_places"), F.col("_regions"))
    event = F.col("kind") == "event"
    empty = lambda c: F.array().cast(rows.schema[c].dataType)
    of_event = lambda c: F.when(event, F.coalesce(c, empty(c))).otherwise(empty(c))
    tried = F.when(event, F.filter(F.array(*(F.lit(p) for p in TRIED)), lambda p: F.array_contains(F.coalesce("_asked", empty("_asked")), p))).otherwise(empty("_asked"))
    providers = F.transform(of_event("_places"), lambda _: F.lit("db"))
    counts = merge.enrich_counts(tried, F.size(of_event("_regions")) + F.size(of_event("_places")), F.col("_hit"))
    none = F.struct(F.lit(False).alias("invoked"), F.lit(0).alias("hits"), F.lit(0).alias("misses"), F.lit(False).alias("cache_hit"))
    enrich = F.when(event, counts).otherwise(none)
    source = F.when(event & F.col("_asked").isNotNull(), merge.source_label(F.concat(tried, F.array_distinct(providers)))).otherwise("local")
    return rows.select(
        key,
        F.struct(F.col("raw_text").alias("text"), "hash", "channel_key", "posted_at").alias("raw"),
        F.struct("kind", F.when(~event, F.col("reason")).alias("reason")).alias("classification"),
        F.when(event, F.struct("event_type", "severity", "repeat", F.col("n").alias("count"), "direction", "macro_zone")).alias("event"),
        F.struct(of_event("_regions").alias("regions"), of_event("_places").alias("places"), F.when(event, precision).otherwise("unknown").alias("precision"),
            F.when(event, completeness).otherwise(0.0).alias("completeness"), source.alias("source")).alias("geo"),
        F.struct(enrich["invoked"].alias("invoked"), tried.alias("providers_tried"), enrich["hits"].alias("hits"), enrich["misses"].alias("misses"), enrich["cache_hit"].alias("cache_hit")).alias("enrich"),
        F.struct(F.lit(version).alias("parser_version"), F.array().cast("array<string>").alias("warnings")).alias("diagnostics"),
    )
