"""Queries over trust, matching, sync, keyed tables, reads, status and events, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_alias, norm_geo
from ..operators import answers, merge, resolve, status, sync, tables, trust
from ..sources import files
from ..streaming import events
from . import posts as P
from .alerts import FULL_SQL, REGION_MATCH_SQL, classified_posts, region_match


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PROVIDER = "CASE o_orderkey % 5 WHEN 0 THEN 'catalog' WHEN 1 THEN 'dadata' WHEN 2 THEN 'nominatim' WHEN 3 THEN 'llm' ELSE 'system' END"
_CONF = "CASE WHEN o_orderkey % 4 <> 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS DOUBLE) / 1000 END"
_CONTRIBUTION = f"o_custkey AS place_id, o_orderkey AS seq, {_PROVIDER} AS provider, {_CONF} AS confidence, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS name, CASE WHEN o_orderkey % 4 = 1 THEN o_orderstatus END AS tag"
_SCORED_SQL = f"""WITH c AS (SELECT {_CONTRIBUTION} FROM orders), s AS (SELECT *, coalesce(confidence, CASE provider WHEN 'catalog' THEN 1.0::DOUBLE WHEN 'dadata' THEN 0.95::DOUBLE WHEN 'nominatim' THEN 0.8::DOUBLE WHEN 'llm' THEN 0.55::DOUBLE ELSE 0.7::DOUBLE END) AS score FROM c),
t AS (SELECT *, provider IN ('catalog', 'dadata', 'operator', 'system') OR score >= 0.9 AS is_trusted FROM s),
k AS (SELECT *, CASE WHEN is_trusted THEN 'verified' WHEN score >= 0.7 THEN 'partially_verified' ELSE 'unverified' END AS state,
  score >= coalesce(max(score) OVER (PARTITION BY place_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS accepted FROM t)"""


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").selectExpr(*_split(_CONTRIBUTION))
    rows = rows.withColumn("score", trust.score_of(F.col("provider"), F.col("confidence")))
    rows = rows.withColumn("is_trusted", trust.is_trusted(F.col("provider"), F.col("score")))
    return rows.withColumn("state", trust.state_of(F.col("is_trusted"), F.col("score")))


def _split(columns: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


_HISTORY = "user_id AS place_id, event_type AS status_code, event_id, ts AS event_at, CASE WHEN event_id % 3 = 0 THEN 'deactivate' ELSE 'activate' END AS action"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").selectExpr(*_split(_HISTORY))


# reference data: customers as places now, and as a source expects them
_CURRENT = "c_custkey AS ord, CASE WHEN c_custkey % 5 <> 0 THEN concat('f', CAST(c_custkey AS VARCHAR(20))) END AS fias_id, CAST(c_nationkey AS VARCHAR(9)) AS region_id, 'locality' AS kind, c_name AS name, c_mktsegment AS segment"
_EXPECTED = "c_custkey AS ord, CASE WHEN c_custkey % 5 <> 0 THEN concat('f', CAST(c_custkey + c_custkey % 2 * CASE WHEN c_custkey % 7 = 0 THEN 1000000 ELSE 0 END AS VARCHAR(20))) END AS fias_id, CAST(c_nationkey AS VARCHAR(9)) AS region_id, 'locality' AS kind, CASE WHEN c_custkey % 11 = 0 THEN concat(c_name, ' new') ELSE c_name END AS name, c_mktsegment AS segment"
_NORM = lambda c: f"trim(regexp_replace(replace(lower({c}), 'ё', 'е'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_PLACES = lambda e: f"SELECT *, coalesce(fias_id, region_id || ':' || kind || ':' || {_NORM('name')}) AS key FROM (SELECT {e} FROM customer)"


def _drafts(spark: SparkSession, sf_dir: str, columns: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").selectExpr(*_split(columns))
    return rows.withColumn("key", sync.place_key(F.col("fias_id"), F.col("region_id"), F.col("kind"), F.col("name")))


def diff_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.diff(_drafts(spark, sf_dir, _EXPECTED), _drafts(spark, sf_dir, _CURRENT), "key", "ord", ("name", "segment")).select("key", "ord", "name", "change")


def diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda v: F.count(F.when(F.col("change") == v, 1)).alias(v)
    return diff_places(spark, sf_dir).agg(n("added"), n("updated"), n("noop"))


def diff_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), norm_geo(F.col("n_name")).alias("key"), F.col("n_regionkey").alias("district"))
    expected = nation.withColumn("district", F.when(F.col("ord") % 4 == 0, F.col("district") + 1).otherwise(F.col("district")))
    return sync.diff(expected, nation.where("ord % 6 <> 5"), "key", "ord", ("district",)).select("key", "change")


def composite_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _t(spark, sf_dir, "supplier").selectExpr("s_nationkey AS key", "s_suppkey AS ord", "s_name AS name").where("ord % 2 = 0")
    b = _t(spark, sf_dir, "customer").selectExpr("c_nationkey AS key", "c_custkey AS ord", "c_name AS name")
    return sync.composite([a, b], "key", "ord").select("key", "ord", "name", "source_ord")


def region_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").selectExpr("c_custkey AS target", "c_custkey AS ord", "c_name", "c_mktsegment", "c_nationkey")
    return sync.key_index(rows, "target", [norm_geo(F.col("c_name")), norm_alias(F.col("c_mktsegment")), F.col("c_nationkey").cast("string")], "ord")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS seq", "CASE WHEN s_suppkey % 3 = 0 THEN concat('f', CAST(s_suppkey * 2 AS VARCHAR(20))) END AS fias_id",
        "CASE WHEN s_suppkey % 10 <> 9 THEN CAST(s_nationkey AS VARCHAR(9)) END AS region_id",
        "CASE WHEN s_suppkey % 8 = 7 THEN '' WHEN s_suppkey % 2 = 0 THEN concat('Customer#', lpad(CAST(s_suppkey AS VARCHAR(20)), 9, '0')) ELSE concat('Town ', CAST(s_suppkey % 13 AS VARCHAR(20))) END AS name",
    )


def match_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _t(spark, sf_dir, "customer").selectExpr("c_custkey AS place_id", *_split(_CURRENT)[1:5])
    aliases = places.where("place_id % 3 = 1").select("place_id", norm_alias(F.col("name")).alias("alias_norm"), F.col("place_id").alias("ord"))
    return resolve.cascade(_candidates(spark, sf_dir), places, aliases)


_CANDIDATES_SQL = """SELECT s_suppkey AS seq, CASE WHEN s_suppkey % 3 = 0 THEN 'f' || (s_suppkey * 2) END AS fias_id, CASE WHEN s_suppkey % 10 <> 9 THEN CAST(s_nationkey AS VARCHAR) END AS region_id,
 CASE WHEN s_suppkey % 8 = 7 THEN '' WHEN s_suppkey % 2 = 0 THEN 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') ELSE 'Town ' || (s_suppkey % 13) END AS name FROM supplier"""
_CASCADE_SQL = f"""WITH c AS ({_CANDIDATES_SQL}), p AS (SELECT c_custkey AS place_id, * FROM (SELECT c_custkey, {_CURRENT} FROM customer)),
l AS (SELECT place_id, trim(lower(name)) AS a FROM p WHERE place_id % 3 = 1),
m AS (SELECT c.*, (SELECT min(place_id) FROM p WHERE p.fias_id = c.fias_id) AS f, (SELECT min(place_id) FROM l WHERE a = regexp_replace(trim(replace(lower(c.name), 'ё', 'е')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS a,
 (SELECT min(place_id) FROM p WHERE p.region_id = c.region_id AND {_NORM('p.name')} = {_NORM('c.name')}) AS n FROM c),
r AS (SELECT seq, fias_id, region_id, name, coalesce(f, a, n) AS place_id, CASE WHEN f IS NOT NULL THEN 'fias' WHEN a IS NOT NULL THEN 'alias' WHEN n IS NOT NULL THEN 'name' END AS matched_by FROM m)"""
_DECIDE_SQL = f"""{_CASCADE_SQL}, v AS (SELECT *, region_id IS NOT NULL AND coalesce(name, '') <> '' AS ok, coalesce(fias_id, concat_ws(':', region_id, {_NORM('name')})) AS new FROM r),
d AS (SELECT *, CASE WHEN NOT ok THEN 'rejected' WHEN place_id IS NOT NULL THEN 'matched' WHEN row_number() OVER (PARTITION BY place_id IS NULL, ok, new ORDER BY seq) = 1 THEN 'created' ELSE 'matched' END AS decision FROM v)"""

# candidates of several providers for one post: parts as places
_NODES = {
    "catalog": "p_partkey AS post_id, 0 AS ord, lower(p_name) AS name, 'city' AS kind, CAST(NULL AS VARCHAR(9)) AS region_code, CASE WHEN p_size > 25 THEN 'c' END AS fias_id, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS DOUBLE) END AS lat, CASE WHEN p_size % 2 = 0 THEN 1.5 END AS lon",
    "llm": "p_partkey AS post_id, 0 AS ord, concat(upper(substring(p_name, 1, 1)), substring(p_name, 2, 99)) AS name, CASE WHEN p_size % 4 = 0 THEN 'district' WHEN p_size % 4 = 1 THEN 'region' ELSE 'settlement' END AS kind, p_brand AS region_code, CASE WHEN p_size > 10 THEN '' END AS fias_id, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon",
    "dadata": "p_partkey AS post_id, 0 AS ord, CASE WHEN p_size % 5 = 0 THEN concat(p_name, ' x') ELSE p_name END AS name, 'locality' AS kind, 'd' AS region_code, 'd' AS fias_id, CAST(2.0 AS DOUBLE) AS lat, CASE WHEN p_size % 3 = 1 THEN CAST(3.0 AS DOUBLE) END AS lon",
}


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    typed = "CAST(lat AS DOUBLE) AS lat", "CAST(lon AS DOUBLE) AS lon"
    return merge.union_candidates({p: part.selectExpr(*_split(e)).selectExpr("post_id", "ord", "name", "kind", "region_code", "fias_id", *typed) for p, e in _NODES.items()})


_NODES_SQL = " UNION ALL ".join(f"SELECT post_id, ord, name, kind, region_code, fias_id, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, '{p}' AS provider, {merge.PROVIDERS.index(p)} AS po FROM (SELECT {e} FROM part)" for p, e in _NODES.items())
_MERGED_SQL = f"""n AS ({_NODES_SQL}), k AS (SELECT *, trim(regexp_replace(replace(lower(name), 'ё', 'е'), '\\s+', ' ', 'g')) AS norm_name FROM n WHERE kind <> 'region'),
g AS (SELECT post_id, norm_name, arg_min(kind, po) AS kind, arg_min(region_code, po) FILTER (coalesce(region_code, '') <> '') AS region_code, arg_min(fias_id, po) FILTER (coalesce(fias_id, '') <> '') AS fias_id,
 coalesce(arg_max(lat, po) FILTER (lat IS NOT NULL AND lon IS NOT NULL), arg_min_null(lat, po)) AS lat, coalesce(arg_max(lon, po) FILTER (lat IS NOT NULL AND lon IS NOT NULL), arg_min_null(lon, po)) AS lon,
 string_agg(provider, ',' ORDER BY po) AS sources, list(name ORDER BY po) AS names FROM k GROUP BY post_id, norm_name),
pl AS (SELECT * EXCLUDE (names), list_reduce(names, lambda a, x: CASE WHEN a[1] = lower(a[1]) AND x[1] = upper(x[1]) THEN x ELSE a END) AS name FROM g)"""


def geo_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    return merge.precision(merge.merge_places(nodes, "post_id"), nodes.where("kind = 'region'").select("post_id"), "post_id")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = classified_posts(spark, sf_dir)
    kinds = F.array_compact(F.array(F.lit("RawMessageIngested"), F.when(F.col("kind") == "event", "MessageParsed").otherwise("MessageParseFailed"), F.when((F.col("kind") == "event") & F.col("n").isNull(), "EnricherInvoked")))
    return e.select("post_id", F.posexplode(kinds).alias("pos", "type"))


_ANSWER = """CASE event_id % 6 WHEN 0 THEN concat('```json\\n{"places":[{"placeName":"P', CAST(user_id AS VARCHAR(9)), '","kind":"city"}],"regionCode":null,"confidence":0.5}\\n```')
 WHEN 1 THEN '{"places":[],"regionCode":"40","reason":"said so"}' WHEN 2 THEN 'no json' WHEN 3 THEN '{"places":[]}' WHEN 4 THEN '{"places":[{"placeName":"A"},{"placeName":"B","kind":"region"}],"other":1}' ELSE '{"regionCode":""}' END"""


def llm_response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _t(spark, sf_dir, "events").selectExpr("event_id", f"{_ANSWER} AS answer")
    parsed = answers.parse_answers(raw, "answer")
    return parsed.select("event_id", F.size("places").cast("long").alias("n_places"), F.get("places", F.lit(0))["placeName"].alias("first_place"), "region_code", "confidence", "reason")


def artifact_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("key"), F.sha2("html", 256).alias("sha256"))
    manifest = pages.select("key", F.when(F.col("page_id") % 9 == 0, "x").otherwise(F.col("sha256")).alias("sha256"))
    return files.verify_artifacts(pages.where("page_id % 9 = 0 OR page_id % 10 <> 0"), manifest)


def channel_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = _t(spark, sf_dir, "supplier").selectExpr("s_suppkey AS channel", "s_suppkey % 5 <> 0 AS enabled", "CASE WHEN s_suppkey % 3 = 0 THEN 500 END AS batch_limit", "CASE WHEN s_suppkey % 4 = 0 THEN true END AS mark_read")
    return answers.plan_channels(channels, {"batch_limit": 100, "mark_read": False})


def ingest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.ingest_types(_t(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "type")


def outbox_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    outbox = _t(spark, sf_dir, "events").selectExpr("event_id", "ts", "CASE WHEN event_type = 'view' THEN ts END AS published_at")
    return events.unpublished(outbox, 100, "ts").select("event_id", "ts")


def _latest(table: str, key: str, order: list[str], columns: list[str]):
    """The first row of each key; an order that starts with "-" is descending."""
    by = lambda: [F.desc(o[1:]) if o[0] == "-" else F.asc(o) for o in order]
    return lambda s, d: tables.first_per_key(_t(s, d, table).selectExpr(*columns), [key], by())


_TOP = lambda q, by, n: lambda s, d: q(s, d).orderBy(*(F.desc(o[1:]) if o[0] == "-" else F.asc(o) for o in by)).limit(n)
_ORDERS = ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"]

QUERIES = {
    "trust_policy": lambda s, d: contributions(s, d).select("seq", "score", "is_trusted", "state"),
    "trust_fold": lambda s, d: trust.fold(contributions(s, d), ("name", "tag")),
    "trust_fields": lambda s, d: trust.applied_fields(contributions(s, d), ("name", "tag")),
    "evidence_providers": lambda s, d: trust.fold(contributions(s, d), ()).select("place_id", "providers"),
    "needs_attention": lambda s, d: trust.fold(contributions(s, d), ()).where(trust.needs_attention(F.col("is_trusted"), F.col("state"))).select("place_id", "state"),
    "draft_keys": lambda s, d: _drafts(s, d, _EXPECTED).select("ord", "key"),
    "diff_places": diff_places,
    "diff_regions": diff_regions,
    "diff_stats": diff_stats,
    "diff_removed": lambda s, d: sync.removed(_drafts(s, d, _EXPECTED), _drafts(s, d, _CURRENT), "key").select("key"),
    "composite_first_wins": composite_first_wins,
    "region_index": region_index,
    "match_cascade": match_cascade,
    "validate_decision": lambda s, d: resolve.decide(match_cascade(s, d)).select("seq", "decision"),
    "validation_tally": lambda s, d: resolve.decide(match_cascade(s, d)).groupBy("decision").agg(F.count(F.lit(1)).alias("n")),
    "union_candidates": lambda s, d: _nodes(s, d).select("post_id", "name", "kind", "provider", "provider_ord"),
    "finalizer_places": lambda s, d: merge.merge_places(_nodes(s, d), "post_id"),
    "finalizer_regions": lambda s, d: merge.merge_regions(_nodes(s, d).withColumn("kind", F.when(F.col("provider") != "dadata", "region").otherwise(F.col("kind"))).withColumn("region_code", F.coalesce("region_code", F.concat(F.lit(" BRAND#"), (F.col("post_id") % 20).cast("string")))), "post_id"),
    "geo_precision": geo_precision,
    "source_label": lambda s, d: contributions(s, d).groupBy("place_id").agg(F.collect_set("provider").alias("p")).select("place_id", merge.source_label(F.col("p")).alias("label")),
    "composite_enrich": lambda s, d: _t(s, d, "part").select("p_partkey", merge.first_answer(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.when(F.col("p_size") % 3 == 0, F.col("p_type")), F.lit("none")).alias("answer")),
    "llm_response_parse": llm_response_parse,
    "telemetry_events": telemetry,
    "ingest_events": ingest_events,
    "dedupe_first": _latest("events", "user_id", ["ts", "event_id"], ["user_id", "ts", "event_id", "event_type"]),
    "cache_latest": _latest("events", "user_id", ["-ts", "-event_id"], ["user_id", "ts", "event_id", "event_type"]),
    "cursor_latest": _latest("orders", "o_custkey", ["-o_orderkey"], ["o_custkey", "o_orderkey", "o_orderstatus"]),
    "evidence_last_n": lambda s, d: tables.top_per_key(_t(s, d, "orders").select(*_ORDERS[:2]), ["o_custkey"], [F.desc("o_orderkey")], 3),
    "upsert_latest": lambda s, d: tables.upsert(
        _t(s, d, "customer").selectExpr("c_custkey AS id", "c_name AS name", "CAST(c_acctbal AS BIGINT) AS v", "CAST(0 AS BIGINT) AS seq"),
        _t(s, d, "orders").selectExpr("o_custkey * 2 AS id", "o_orderstatus AS name", "CAST(floor(o_totalprice) AS BIGINT) AS v", "o_orderkey AS seq"), ["id"], [F.desc("seq")]),
    "status_upsert": lambda s, d: tables.upsert(
        _t(s, d, "customer").selectExpr("c_custkey AS id", "c_name AS started", "c_mktsegment AS meta", "CAST(0 AS BIGINT) AS seq"),
        _t(s, d, "orders").selectExpr("o_custkey * 2 AS id", "o_orderstatus AS started", "o_orderpriority AS meta", "o_orderkey AS seq"), ["id"], [F.desc("seq")], keep=("started",)),
    "replace_children": lambda s, d: tables.replace_children(
        _t(s, d, "lineitem").selectExpr("l_orderkey", "CAST(l_linenumber AS BIGINT) AS line"), _t(s, d, "orders").where("o_orderkey % 10 = 0").selectExpr("o_orderkey AS l_orderkey", "CAST(100 AS BIGINT) AS line"), "l_orderkey"),
    "fk_orphans": lambda s, d: tables.orphans(_t(s, d, "orders").selectExpr("o_orderkey", "o_custkey + 1 AS o_custkey"), "o_custkey", _t(s, d, "customer"), "c_custkey").select("o_orderkey", "o_custkey"),
    "status_current": lambda s, d: status.as_of(history(s, d)),
    "status_as_of": lambda s, d: status.as_of(history(s, d), F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")),
    "place_status": _TOP(lambda s, d: tables.where_given(status.as_of(history(s, d)), place_id=None, status_code="click"), ["-since", "place_id"], 500),
    "place_status_history": _TOP(lambda s, d: tables.where_given(history(s, d), place_id=1, status_code=None), ["-event_at", "-event_id"], 1000),
    "events_feed": _TOP(lambda s, d: P.posts(s, d).select("post_id", "posted_at"), ["-posted_at", "-post_id"], 100),
    "outbox_batch": outbox_batch,
    "regions_list": _TOP(lambda s, d: _t(s, d, "nation").select("n_name", "n_nationkey"), ["n_name"], 500),
    "dictionary": _TOP(lambda s, d: _t(s, d, "part").select("p_size", "p_partkey", "p_brand"), ["p_size", "p_partkey"], 500),
    "sync_history": _TOP(lambda s, d: _t(s, d, "orders").select("o_orderkey", "o_orderdate"), ["-o_orderdate", "-o_orderkey"], 100),
    "events_in_range": lambda s, d: P.posts(s, d).where("posted_at >= TIMESTAMP_NTZ '2024-01-10 00:00:00' AND posted_at < TIMESTAMP_NTZ '2024-01-12 00:00:00'").select("post_id", "channel_key"),
    "events_by_region": lambda s, d: region_match(s, d).where("code = '40'").select("post_id", "rank"),
    "channel_plan": channel_plan,
    "artifact_verify": artifact_verify,
    "activity_tumbling": lambda s, d: _t(s, d, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n"),
    "activity_session": lambda s, d: _t(s, d, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n"),
    "analytics_rollup": lambda s, d: _t(s, d, "events").rollup("event_type", (F.col("user_id") % 5).alias("bucket")).agg(F.count(F.lit(1)).alias("n")),
    "analytics_heatmap": lambda s, d: _t(s, d, "events").groupBy(F.dayofweek("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n")),
}

_FOLD_SQL = f"""{_SCORED_SQL}, pv AS (SELECT place_id, string_agg(provider, ',' ORDER BY f) AS providers FROM (SELECT place_id, provider, min(seq) AS f FROM k GROUP BY 1, 2) GROUP BY 1),
fo AS (SELECT place_id, coalesce(arg_max(name, seq) FILTER (accepted AND name IS NOT NULL), arg_min(name, seq) FILTER (name IS NOT NULL)) AS name, coalesce(arg_max(tag, seq) FILTER (accepted AND tag IS NOT NULL), arg_min(tag, seq) FILTER (tag IS NOT NULL)) AS tag,
 max(score) AS score, bool_or(is_trusted) AS is_trusted, arg_max(state, list_position(['rejected', 'unverified', 'partially_verified', 'verified'], state)) AS state, count(*) AS n FROM k GROUP BY place_id)"""
_HIST = f"WITH h AS (SELECT {_HISTORY} FROM events)"
_ASOF = lambda w: f"{_HIST}, l AS (SELECT place_id, status_code, arg_max(action, (event_at, event_id)) AS action, max(event_at) AS since FROM h {w} GROUP BY 1, 2), a AS (SELECT place_id, status_code, since FROM l WHERE action = 'activate')"
_FIRST = lambda cols, table, key, order: f"SELECT {cols} FROM {table} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1"
_UPSERT = lambda base, upd, keep: f"WITH b AS ({base}), u AS ({upd} QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) {keep} FROM b FULL JOIN u ON b.id = u.id"
_DIFF = f"""WITH e AS ({_PLACES(_EXPECTED)}), c AS ({_PLACES(_CURRENT)} QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord DESC) = 1),
d AS (SELECT e.key, e.ord, e.name, CASE WHEN c.key IS NULL THEN 'added' WHEN coalesce(e.name, '') = coalesce(c.name, '') AND coalesce(e.segment, '') = coalesce(c.segment, '') THEN 'noop' ELSE 'updated' END AS change FROM e LEFT JOIN c ON e.key = c.key)"""

ORACLE = {
    "trust_policy": f"{_SCORED_SQL} SELECT seq, score, is_trusted, state FROM k",
    "trust_fold": f"{_FOLD_SQL} SELECT place_id, name, tag, score, is_trusted, state, providers, n FROM fo JOIN pv USING (place_id)",
    "evidence_providers": f"{_FOLD_SQL} SELECT place_id, providers FROM pv",
    "trust_fields": f"""{_SCORED_SQL}, w AS (SELECT *, CASE WHEN name IS NOT NULL AND (accepted OR count(name) OVER b = 0) THEN name END AS sn, CASE WHEN tag IS NOT NULL AND (accepted OR count(tag) OVER b = 0) THEN tag END AS st FROM k
 WINDOW b AS (PARTITION BY place_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, last_value(sn IGNORE NULLS) OVER b AS wn, last_value(st IGNORE NULLS) OVER b AS wt FROM w WINDOW b AS (PARTITION BY place_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT place_id, seq, concat_ws(',', CASE WHEN sn IS NOT NULL AND sn IS DISTINCT FROM wn THEN 'name' END, CASE WHEN st IS NOT NULL AND st IS DISTINCT FROM wt THEN 'tag' END) AS applied FROM x)
SELECT place_id, seq, applied, CASE WHEN applied <> '' THEN 'enrich' ELSE 'confirm' END AS action FROM y""",
    "needs_attention": f"{_FOLD_SQL} SELECT place_id, state FROM fo WHERE NOT is_trusted OR state = 'unverified'",
    "draft_keys": f"SELECT ord, key FROM ({_PLACES(_EXPECTED)})",
    "diff_places": f"{_DIFF} SELECT * FROM d",
    "diff_stats": f"{_DIFF} SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change = 'noop') AS noop FROM d",
    "diff_removed": f"SELECT key FROM ({_PLACES(_CURRENT)}) WHERE key NOT IN (SELECT key FROM ({_PLACES(_EXPECTED)}))",
    "diff_regions": f"""WITH c AS (SELECT n_nationkey AS ord, {_NORM('n_name')} AS key, n_regionkey AS d FROM nation), e AS (SELECT ord, key, CASE WHEN ord % 4 = 0 THEN d + 1 ELSE d END AS d FROM c), o AS (SELECT * FROM c WHERE ord % 6 <> 5)
SELECT e.key, CASE WHEN o.key IS NULL THEN 'added' WHEN e.d = o.d THEN 'noop' ELSE 'updated' END AS change FROM e LEFT JOIN o ON e.key = o.key""",
    "composite_first_wins": "SELECT key, ord, name, so AS source_ord FROM (SELECT s_nationkey AS key, s_suppkey AS ord, s_name AS name, 0 AS so FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT c_nationkey, c_custkey, c_name, 1 FROM customer) QUALIFY row_number() OVER (PARTITION BY key ORDER BY so, ord) = 1",
    "region_index": f"SELECT key, max(target) AS target FROM (SELECT c_custkey AS target, unnest([{_NORM('c_name')}, trim(lower(c_mktsegment)), CAST(c_nationkey AS VARCHAR)]) AS key FROM customer) GROUP BY key",
    "match_cascade": f"{_CASCADE_SQL} SELECT * FROM r",
    "validate_decision": f"{_DECIDE_SQL} SELECT seq, decision FROM d",
    "validation_tally": f"{_DECIDE_SQL} SELECT decision, count(*) AS n FROM d GROUP BY decision",
    "union_candidates": f"SELECT post_id, name, kind, provider, po AS provider_ord FROM ({_NODES_SQL})",
    "finalizer_places": f"WITH {_MERGED_SQL} SELECT * FROM pl",
    "finalizer_regions": f"""WITH n AS ({_NODES_SQL}), r AS (SELECT post_id, name, provider, po, lower(trim(coalesce(region_code, ' BRAND#' || (post_id % 20)))) AS code FROM n WHERE provider <> 'dadata')
SELECT post_id, code, arg_min(name, po) AS name, arg_min(provider, po) AS provider FROM r GROUP BY post_id, code""",
    "geo_precision": f"""WITH {_MERGED_SQL}, a AS (SELECT post_id, bool_or(kind IN ('city', 'locality')) AS c, bool_or(lat IS NOT NULL AND lon IS NOT NULL) AS x, bool_or(kind = 'district') AS d FROM pl GROUP BY post_id),
r AS (SELECT DISTINCT post_id FROM n WHERE kind = 'region')
SELECT post_id, CASE WHEN c AND x THEN 'locality_with_coords' WHEN c THEN 'locality' WHEN d THEN 'district' ELSE 'region' END AS precision, CASE WHEN c AND x THEN 1.0::DOUBLE WHEN c THEN 0.75::DOUBLE WHEN d THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS completeness FROM a FULL JOIN r USING (post_id)""",
    "source_label": f"WITH c AS (SELECT {_CONTRIBUTION} FROM orders) SELECT place_id, CASE WHEN count(DISTINCT provider) > 1 THEN 'multi' ELSE min(provider) END AS label FROM c GROUP BY place_id",
    "composite_enrich": "SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN p_brand END, CASE WHEN p_size % 3 = 0 THEN p_type END, 'none') AS answer FROM part",
    "llm_response_parse": f"""WITH a AS (SELECT event_id, regexp_replace(regexp_replace(replace({_ANSWER}, '\\n', chr(10)), '^```json', ''), '```$', '') AS t FROM events), j AS (SELECT event_id, TRY_CAST(t AS JSON) AS j FROM a)
SELECT event_id, CAST(coalesce(json_array_length(j, '$.places'), 0) AS BIGINT) AS n_places, json_extract_string(j, '$.places[0].placeName') AS first_place, json_extract_string(j, '$.regionCode') AS region_code,
 CAST(json_extract_string(j, '$.confidence') AS DOUBLE) AS confidence, json_extract_string(j, '$.reason') AS reason FROM j WHERE coalesce(json_array_length(j, '$.places'), 0) > 0 OR coalesce(json_extract_string(j, '$.regionCode'), '') <> ''""",
    "telemetry_events": f"""WITH f AS ({FULL_SQL}) SELECT post_id, 0 AS pos, 'RawMessageIngested' AS type FROM f UNION ALL SELECT post_id, 1, CASE WHEN kind = 'event' THEN 'MessageParsed' ELSE 'MessageParseFailed' END FROM f
 UNION ALL SELECT post_id, 2, 'EnricherInvoked' FROM f WHERE kind = 'event' AND n IS NULL""",
    "ingest_events": "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 THEN 'RawMessageIngested' ELSE 'RawMessageDuplicate' END AS type FROM events",
    "dedupe_first": _FIRST("user_id, ts, event_id, event_type", "events", "user_id", "ts, event_id"),
    "cache_latest": _FIRST("user_id, ts, event_id, event_type", "events", "user_id", "ts DESC, event_id DESC"),
    "cursor_latest": _FIRST("o_custkey, o_orderkey, o_orderstatus", "orders", "o_custkey", "o_orderkey DESC"),
    "evidence_last_n": "SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS INTEGER) AS rank FROM orders QUALIFY rank <= 3",
    "upsert_latest": _UPSERT("SELECT c_custkey AS id, c_name AS name, CAST(trunc(c_acctbal) AS BIGINT) AS v, 0 AS seq FROM customer", "SELECT o_custkey * 2 AS id, o_orderstatus AS name, CAST(floor(o_totalprice) AS BIGINT) AS v, o_orderkey AS seq FROM orders",
        "SELECT coalesce(u.id, b.id) AS id, coalesce(u.name, b.name) AS name, coalesce(u.v, b.v) AS v, CAST(coalesce(u.seq, b.seq) AS BIGINT) AS seq"),
    "status_upsert": _UPSERT("SELECT c_custkey AS id, c_name AS started, c_mktsegment AS meta, 0 AS seq FROM customer", "SELECT o_custkey * 2 AS id, o_orderstatus AS started, o_orderpriority AS meta, o_orderkey AS seq FROM orders",
        "SELECT coalesce(u.id, b.id) AS id, coalesce(b.started, u.started) AS started, coalesce(u.meta, b.meta) AS meta, CAST(coalesce(u.seq, b.seq) AS BIGINT) AS seq"),
    "replace_children": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0) UNION ALL SELECT o_orderkey, 100 FROM orders WHERE o_orderkey % 10 = 0",
    "fk_orphans": "SELECT o_orderkey, o_custkey + 1 AS o_custkey FROM orders WHERE o_custkey + 1 NOT IN (SELECT c_custkey FROM customer)",
    "status_current": f"{_ASOF('')} SELECT * FROM a",
    "status_as_of": f"{_ASOF(chr(10) + 'WHERE event_at <= TIMESTAMP ' + chr(39) + '2024-01-15 00:00:00' + chr(39))} SELECT * FROM a",
    "place_status": f"{_ASOF('')} SELECT * FROM a WHERE status_code = 'click' ORDER BY since DESC, place_id LIMIT 500",
    "place_status_history": f"{_HIST} SELECT * FROM h WHERE place_id = 1 ORDER BY event_at DESC, event_id DESC LIMIT 1000",
    "events_feed": "SELECT event_id AS post_id, ts AS posted_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 100",
    "outbox_batch": "SELECT event_id, ts FROM events WHERE event_type <> 'view' ORDER BY ts, event_id LIMIT 100",
    "regions_list": "SELECT n_name, n_nationkey FROM nation ORDER BY n_name LIMIT 500",
    "dictionary": "SELECT p_size, p_partkey, p_brand FROM part ORDER BY p_size, p_partkey LIMIT 500",
    "sync_history": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100",
    "events_in_range": "SELECT event_id AS post_id, 'ch' || (user_id % 7) AS channel_key FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'",
    "events_by_region": f"WITH g AS ({REGION_MATCH_SQL}) SELECT post_id, rank FROM g WHERE code = '40'",
    "channel_plan": "SELECT s_suppkey AS channel, CASE WHEN s_suppkey % 3 = 0 THEN 500 ELSE 100 END AS batch_limit, s_suppkey % 4 = 0 AS mark_read FROM supplier WHERE s_suppkey % 5 <> 0",
    "artifact_verify": "SELECT count(*) AS files, count(*) FILTER (page_id % 9 <> 0 AND page_id % 10 = 0) AS missing, count(*) FILTER (page_id % 9 = 0) AS mismatch FROM pages",
    "activity_tumbling": "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "activity_session": """WITH a AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 2 HOURS THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, g""",
    "analytics_rollup": "SELECT event_type, user_id % 5 AS bucket, count(*) AS n FROM events GROUP BY ROLLUP (event_type, bucket)",
    "analytics_heatmap": "SELECT CAST(dayofweek(ts) + 1 AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY 1, 2",
}
