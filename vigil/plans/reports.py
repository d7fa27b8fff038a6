"""Queries of reports per post and per message, of channels and of content in parts; DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers, reports, resolve, sync, tables, trust
from . import posts as P
from .alerts import _CITY_SQL, FULL_SQL, REGION_MATCH_SQL, _city_match, classified_posts, region_match
from .domain import _CONTRIBUTION, _DECIDE_SQL, _NORM, _split, _t, match_cascade

_ASKED = "event_id AS post_id, CASE event_id % 3 WHEN 0 THEN 'llm' WHEN 1 THEN 'dadata' ELSE 'nominatim' END AS provider, event_id % 4 = 1 AS cache_hit"


def nested_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested report of each post, its paths as columns."""
    rows = P.posts(spark, sf_dir).select("post_id", "posted_at", F.sha2("raw_text", 256).alias("hash")).join(classified_posts(spark, sf_dir).hint("merge"), "post_id")
    places = _city_match(spark, sf_dir).select("post_id", "name", F.lit("city").alias("kind"), F.lit(None).cast("string").alias("region_code"), F.when(F.col("name") != "Тула", F.col("lat")).alias("lat"), "lon")
    asked = _t(spark, sf_dir, "events").where("event_id % 5 <> 0").selectExpr(*_split(_ASKED))
    r = reports.nested(rows, region_match(spark, sf_dir), places, asked)
    names = lambda c, of: F.array_join(F.transform(F.col(c), lambda x: x[of]), "|")
    return r.select(
        "post_id", "raw.hash", "raw.channel_key", "raw.posted_at", "classification.kind", "classification.reason", "event.event_type", "event.severity", "event.count", names("geo.regions", "code").alias("regions"),
        names("geo.places", "name").alias("places"), "geo.precision", "geo.completeness", "geo.source", "enrich.invoked", F.array_join("enrich.providers_tried", ",").alias("tried"), "enrich.hits", "enrich.misses", "enrich.cache_hit", "diagnostics.parser_version",
    )


_NESTED_SQL = f"""WITH f AS ({FULL_SQL}), p AS ({P.posts_sql()}), g AS ({REGION_MATCH_SQL}), c AS ({_CITY_SQL}), rg AS (SELECT post_id, string_agg(code, '|' ORDER BY name, code) AS regions, count(*) AS nr FROM (SELECT DISTINCT post_id, code, name FROM g) GROUP BY post_id),
pl AS (SELECT post_id, string_agg(name, '|' ORDER BY name) AS places, count(*) AS np, bool_or(name <> 'Тула' AND lat IS NOT NULL) AS xy FROM (SELECT DISTINCT post_id, name, lat, lon FROM c) GROUP BY post_id),
a AS (SELECT {_ASKED} FROM events WHERE event_id % 5 <> 0),
j AS (SELECT f.*, p.posted_at, rg.regions, pl.places, coalesce(nr, 0) AS nr, coalesce(np, 0) AS np, coalesce(xy, FALSE) AS xy, a.provider, a.cache_hit AS hit, kind = 'event' AS e
 FROM f JOIN p USING (post_id) LEFT JOIN rg USING (post_id) LEFT JOIN pl USING (post_id) LEFT JOIN a USING (post_id))
SELECT post_id, sha256(raw_text) AS hash, channel_key, posted_at, kind, CASE WHEN NOT e THEN reason END AS reason, CASE WHEN e THEN event_type END AS event_type, CASE WHEN e THEN severity END AS severity, CASE WHEN e THEN n END AS count,
 CASE WHEN e THEN coalesce(regions, '') ELSE '' END AS regions, CASE WHEN e THEN coalesce(places, '') ELSE '' END AS places,
 CASE WHEN NOT e OR nr + np = 0 THEN 'unknown' WHEN xy THEN 'locality_with_coords' WHEN np > 0 THEN 'locality' ELSE 'region' END AS precision,
 CASE WHEN NOT e OR nr + np = 0 THEN 0.0::DOUBLE WHEN xy THEN 1.0::DOUBLE WHEN np > 0 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS completeness,
 CASE WHEN NOT e OR provider IS NULL THEN 'local' WHEN np > 0 THEN 'multi' ELSE provider END AS source, e AND provider IS NOT NULL AS invoked, CASE WHEN e THEN coalesce(provider, '') ELSE '' END AS tried,
 CAST(CASE WHEN e THEN nr + np ELSE 0 END AS INTEGER) AS hits, CAST(CASE WHEN e AND nr + np = 0 THEN 1 ELSE 0 END AS INTEGER) AS misses, e AND coalesce(hit, FALSE) AND provider IN ('dadata', 'nominatim') AS cache_hit, '0.1.0' AS parser_version FROM j"""


def _by_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.tallies(resolve.decide(match_cascade(spark, sf_dir)).withColumn("message", F.floor(F.col("seq") / 4).cast("long")), "message")


_MESSAGE_SQL = f"{_DECIDE_SQL}, t AS (SELECT CAST(floor(seq / 4) AS BIGINT) AS message, count(*) FILTER (decision = 'matched') AS known, count(*) FILTER (decision = 'created') AS created, count(*) FILTER (decision = 'rejected') AS rejected, bool_or(decision <> 'rejected') AS has_accepted FROM d GROUP BY 1)"

# channels that messages name: those that are known stay, others are added once
_CHANNELS = "s_suppkey AS key, s_name AS title"


def channels_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _t(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").selectExpr(*_split(_CHANNELS))
    named = _t(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS key", "concat('new ', CAST(l_suppkey AS VARCHAR(20))) AS title").distinct()
    return tables.insert_missing(known, named, ["key"])


# aliases by kind, region, place and normalised text
_FOUR = "CASE WHEN o_orderkey % 2 = 0 THEN 'region' ELSE 'place' END AS target_kind, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey % 7 AS VARCHAR(9)) END AS region_id, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey % 50 END AS place_id, concat(' ', CASE WHEN o_orderkey % 5 = 0 THEN upper(o_orderpriority) ELSE o_orderpriority END) AS alias, o_orderkey AS seq, CASE WHEN o_orderkey % 11 = 0 THEN 'manual' ELSE 'auto' END AS source"


def alias_four_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored aliases of the first orders, some retired, with all others laid over them by the four parts of their key."""
    rows = _t(spark, sf_dir, "orders").selectExpr(*_split(_FOUR)).withColumn("alias_norm", sync.norm_geo(F.col("alias")))
    rows = rows.withColumn("k", F.concat_ws("/", "target_kind", F.coalesce("region_id", F.lit("-")), F.coalesce(F.col("place_id").cast("string"), F.lit("-")), "alias_norm"))
    old = tables.first_per_key(rows.where("seq % 4 = 0"), ["k"], ["seq"]).select("k", "alias", "source", (F.col("seq") % 8 != 0).alias("is_active"), F.when(F.col("seq") % 8 == 0, F.lit("2024")).alias("deprecated_at"))
    return tables.upsert_aliases(old, rows.where("seq % 4 <> 0").select("k", "alias", "source", "seq"), ["k"], [F.desc("seq")])


_FOUR_SQL = f"""WITH r AS (SELECT *, target_kind || '/' || coalesce(region_id, '-') || '/' || coalesce(CAST(place_id AS VARCHAR), '-') || '/' || {_NORM('alias')} AS k FROM (SELECT {_FOUR} FROM orders)),
o AS (SELECT * FROM r WHERE seq % 4 = 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq) = 1), u AS (SELECT * FROM r WHERE seq % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1)
SELECT coalesce(u.k, o.k) AS k, CASE WHEN u.k IS NULL THEN o.alias ELSE u.alias END AS alias, CASE WHEN u.k IS NULL THEN o.source ELSE u.source END AS source, CASE WHEN u.k IS NULL THEN o.seq % 8 <> 0 ELSE TRUE END AS is_active,
 CASE WHEN u.k IS NULL AND o.seq % 8 = 0 THEN '2024' END AS deprecated_at FROM o FULL JOIN u ON o.k = u.k"""

_SOURCES = "CASE o_orderkey % 5 WHEN 0 THEN 'db' WHEN 1 THEN 'cache' WHEN 2 THEN 'llm' WHEN 3 THEN 'dadata' ELSE 'nominatim' END"


def source_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations by the source that they come from, as the trust policy sees it."""
    rows = _t(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_SOURCES} AS source", _split(_CONTRIBUTION)[3])
    rows = rows.withColumn("provider", trust.provider_of(F.col("source"))).withColumn("score", trust.score_of(F.col("provider"), F.col("confidence")))
    trusted = trust.is_trusted(F.col("provider"), F.col("score"))
    state = trust.state_of(trusted, F.col("score"))
    return rows.select("o_orderkey", "provider", "score", state.alias("state"), trust.needs_attention(trusted, state).alias("attention"))


_SOURCE_SQL = f"""WITH s AS (SELECT o_orderkey, {_SOURCES} AS source, {_split(_CONTRIBUTION)[3]} FROM orders), p AS (SELECT *, CASE source WHEN 'db' THEN 'catalog' WHEN 'cache' THEN 'system' ELSE source END AS provider FROM s),
q AS (SELECT *, coalesce(confidence, CASE provider WHEN 'catalog' THEN 1.0::DOUBLE WHEN 'dadata' THEN 0.95::DOUBLE WHEN 'nominatim' THEN 0.8::DOUBLE WHEN 'llm' THEN 0.55::DOUBLE ELSE 0.7::DOUBLE END) AS score FROM p),
t AS (SELECT *, provider IN ('catalog', 'dadata', 'system') OR score >= 0.9 AS trusted FROM q)
SELECT o_orderkey, provider, score, CASE WHEN trusted THEN 'verified' WHEN score >= 0.7 THEN 'partially_verified' ELSE 'unverified' END AS state, NOT trusted OR (NOT trusted AND score < 0.7) AS attention FROM t"""


def content_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that come in parts, some without text, read as JSON once joined."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    head, mid, tail = F.concat(F.lit('  ```json\n{"regionCode":"'), F.col("p_brand")), F.lit(None).cast("string"), F.concat(F.lit('","confidence":0.'), (F.col("p_size") % 10).cast("string"), F.lit("}\n``` "))
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.array(part("text", head), part("image", mid), part("text", tail)).alias("parts"))
    return answers.parse_answers(rows.select("p_partkey", answers.content_text(F.col("parts")).alias("answer")), "answer").select("p_partkey", "region_code", "confidence")


QUERIES = {
    "nested_reports": nested_reports,
    "message_tallies": _by_message,
    "message_totals": lambda s, d: resolve.message_totals(_by_message(s, d)),
    "channels_added": channels_added,
    "alias_four_keys": alias_four_keys,
    "source_trust": source_trust,
    "content_parts": content_parts,
}

ORACLE = {
    "nested_reports": _NESTED_SQL,
    "message_tallies": f"{_MESSAGE_SQL} SELECT * FROM t",
    "message_totals": f"{_MESSAGE_SQL} SELECT count(*) AS messages, CAST(sum(known) AS BIGINT) AS known, CAST(sum(created) AS BIGINT) AS created, CAST(sum(rejected) AS BIGINT) AS rejected, count(*) FILTER (has_accepted) AS accepted, count(*) FILTER (NOT has_accepted) AS none_accepted FROM t",
    "channels_added": "SELECT s_suppkey AS key, s_name AS title FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT DISTINCT l_suppkey, 'new ' || l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)",
    "alias_four_keys": _FOUR_SQL,
    "source_trust": _SOURCE_SQL,
    "content_parts": "SELECT p_partkey, p_brand AS region_code, CAST('0.' || (p_size % 10) AS DOUBLE) AS confidence FROM part",
}
