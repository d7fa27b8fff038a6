"""Queries over the geo steps, links and aliases of reference data, service decisions and reads, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import norm_geo
from ..operators import gazetteer, geo, resolve, sync, tables
from ..sources import snapshots
from ..streaming import events
from . import domain as D
from . import posts as P
from .alerts import _CITY_SQL, FULL_SQL, REGION_MATCH_SQL, _cities, region_match

_N = D._NORM


def _sorted(rows: DataFrame, order: list, n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


# places of a post
_NAMED = "p_size AS post_id, CASE WHEN p_partkey % 3 = 0 THEN 'district' ELSE 'city' END AS kind, CASE p_partkey % 4 WHEN 0 THEN upper(p_brand) WHEN 1 THEN concat(' \"', p_brand, '\" ') ELSE lower(p_brand) END AS name, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS lat, CAST(p_partkey AS DOUBLE) AS lon, p_partkey AS ord"


def place_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gazetteer.dedupe_places(D._t(spark, sf_dir, "part").selectExpr(*D._split(_NAMED)), "post_id")


def catalog_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.catalog_places(P.posts(spark, sf_dir), "post_id", "raw_text", P.regions(spark), _cities(spark))


_LLM = "p_partkey AS node, p_size AS post_id, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN concat(upper(p_brand), ' region') ELSE p_name END AS name, CASE WHEN p_partkey % 3 = 0 THEN 'city' ELSE 'region' END AS kind, CASE WHEN p_partkey % 5 = 0 THEN 'own' END AS own_code, CASE WHEN p_partkey % 7 = 0 THEN 'answer' END AS answer_code, CASE WHEN p_partkey % 2 = 0 THEN 'hint' END AS hint"
_KNOWN = "p_size AS post_id, concat('c', CAST(p_partkey AS VARCHAR(20))) AS code, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE concat(' ', p_brand, '  area') END AS name, p_partkey AS ord"


def llm_region_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = D._t(spark, sf_dir, "part")
    return geo.region_codes(part.selectExpr(*D._split(_LLM)), part.selectExpr(*D._split(_KNOWN)).where("ord % 3 <> 1"), "post_id").select("node", "region_code")


# links of drafts and aliases
_DRAFT = D._EXPECTED.replace("AS region_id", "AS region_code")
_REGIONS = "SELECT key, max(target) AS target FROM (SELECT CAST(n_nationkey AS VARCHAR) AS target, unnest([CAST(n_nationkey AS VARCHAR), trim(lower(n_name))]) AS key FROM nation WHERE n_nationkey % 7 <> 3) GROUP BY key"


def _region_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D._t(spark, sf_dir, "nation").where("n_nationkey % 7 <> 3").selectExpr("CAST(n_nationkey AS STRING) AS target", "n_nationkey AS ord", "n_name")
    return sync.key_index(rows, "target", [F.col("target"), F.trim(F.lower("n_name"))], "ord")


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    index = _region_index(spark, sf_dir)
    drafts = sync.resolve_key(D._t(spark, sf_dir, "customer").selectExpr(*D._split(_DRAFT)), index, "region_code", "region_id")
    places = D._t(spark, sf_dir, "customer").selectExpr("c_custkey AS place_id", *D._split(D._CURRENT)[1:5])
    return index, drafts, sync.link_places(drafts, places)


def place_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir)[2]


def alias_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, drafts, links = _linked(spark, sf_dir)
    names = F.array(F.col("name"), F.when(F.col("ord") % 4 == 0, F.concat(F.lit("town "), "name")), F.when(F.col("ord") % 9 == 0, F.lit("!?")))
    given = D._t(spark, sf_dir, "nation").selectExpr("'region' AS target_kind", "CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE CAST(n_nationkey AS STRING) END AS target_key", "concat(n_name, ' land') AS alias", "'manual' AS source")
    return sync.alias_rows(given, drafts.withColumn("names", names), index, links)


_LINK_SQL = f"""ri AS ({_REGIONS}), dr AS (SELECT d.*, coalesce(a.target, b.target) AS region_id FROM (SELECT {_DRAFT} FROM customer) d LEFT JOIN ri a ON a.key = d.region_code LEFT JOIN ri b ON b.key = {_N('d.region_code')}),
pl AS (SELECT c_custkey AS place_id, * FROM (SELECT c_custkey, {D._CURRENT} FROM customer)), bf AS (SELECT fias_id, max(place_id) AS f FROM pl WHERE coalesce(fias_id, '') <> '' GROUP BY fias_id),
bn AS (SELECT region_id || ':' || kind || ':' || {_N('name')} AS nat, max(place_id) AS n FROM pl GROUP BY 1),
li AS (SELECT coalesce(dr.fias_id, region_code || ':' || kind || ':' || {_N('name')}) AS draft_key, arg_max(CASE WHEN coalesce(dr.fias_id, '') <> '' THEN f ELSE n END, ord) AS place_id
  FROM dr LEFT JOIN bf ON bf.fias_id = dr.fias_id LEFT JOIN bn ON bn.nat = dr.region_id || ':' || kind || ':' || {_N('name')} WHERE region_id IS NOT NULL AND CASE WHEN coalesce(dr.fias_id, '') <> '' THEN f ELSE n END IS NOT NULL GROUP BY 1)"""
_ALIAS_SQL = f"""{_LINK_SQL}, ow AS (SELECT coalesce(fias_id, region_code || ':' || kind || ':' || {_N('name')}) AS k, unnest([name, CASE WHEN ord % 4 = 0 THEN 'town ' || name END, CASE WHEN ord % 9 = 0 THEN '!?' END]) AS alias FROM dr),
gi AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE CAST(n_nationkey AS VARCHAR) END AS k, n_name || ' land' AS alias FROM nation),
ar AS (SELECT 'place' AS target_kind, CAST(NULL AS VARCHAR) AS region_id, li.place_id, alias, {_N('alias')} AS alias_norm, 'auto' AS source FROM ow JOIN li ON li.draft_key = ow.k WHERE {_N('alias')} <> ''
  UNION ALL SELECT 'region', coalesce(a.target, b.target), NULL, alias, {_N('alias')}, 'manual' FROM gi LEFT JOIN ri a ON a.key = gi.k LEFT JOIN ri b ON b.key = {_N('gi.k')} WHERE coalesce(a.target, b.target) IS NOT NULL)"""


def _alias_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.concat_ws(":", "target_kind", F.coalesce("region_id", F.col("place_id").cast("string")), norm_geo(F.col("alias"))))


def diff_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = D._t(spark, sf_dir, "customer").where("c_custkey % 9 <> 0").selectExpr(
        "'place' AS target_kind", "CAST(NULL AS STRING) AS region_id", "c_custkey AS place_id", "CASE WHEN c_custkey % 8 = 0 THEN upper(c_name) ELSE c_name END AS alias", "c_custkey AS ord"
    )
    return sync.diff(_alias_key(alias_rows(spark, sf_dir)), _alias_key(stored), "key", "ord", ("alias",)).select("key", "alias", "change")


def diff_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.changes(D.diff_places(spark, sf_dir), "ord").select("ord", "key", "change")


_CODES = "SELECT s_suppkey AS seq, CASE s_suppkey % 4 WHEN 0 THEN 'f' || s_nationkey WHEN 1 THEN 'I' || s_nationkey WHEN 2 THEN 'none' ELSE 'region ' || s_nationkey END AS code FROM supplier"


def region_multikey(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = D._t(spark, sf_dir, "supplier").selectExpr("s_suppkey AS seq", "CASE s_suppkey % 4 WHEN 0 THEN concat('f', s_nationkey) WHEN 1 THEN concat('I', s_nationkey) WHEN 2 THEN 'none' ELSE concat('region ', s_nationkey) END AS code")
    regions = D._t(spark, sf_dir, "nation").selectExpr("n_nationkey AS region_id", "CASE WHEN n_nationkey % 2 = 0 THEN concat('f', n_nationkey) END AS fias", "concat('I', n_nationkey % 20) AS iso", "concat('region ', n_nationkey % 10) AS name")
    return sync.region_by_any_key(codes, "code", regions, ("fias", "iso", "name")).select("seq", "region_id")


def validate_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.match_cascade(spark, sf_dir).withColumn("fallback", F.when(F.col("seq") % 2 == 0, "7"))
    return resolve.decide_api(rows, "fallback").select("seq", "decision", "cached")


_API_SQL = f"""{D._CASCADE_SQL}, z AS (SELECT *, coalesce(region_id, CASE WHEN seq % 2 = 0 THEN '7' END) AS rg, coalesce(name, '') <> '' AS nm FROM r),
y AS (SELECT *, rg IS NOT NULL AND place_id IS NULL AND nm AS op, coalesce(nullif(fias_id, ''), concat_ws(':', rg, {_N('name')})) AS new FROM z),
x AS (SELECT seq, rg, CASE WHEN rg IS NULL THEN 'rejected' WHEN place_id IS NOT NULL THEN 'matched_existing' WHEN NOT nm THEN 'rejected' WHEN row_number() OVER (PARTITION BY op, new ORDER BY seq) = 1 THEN 'created_new' ELSE 'matched_existing' END AS decision FROM y)
SELECT seq, decision, CASE WHEN decision = 'created_new' THEN 'validated' WHEN decision = 'rejected' AND rg IS NOT NULL THEN 'none' ELSE 'plain' END AS cached FROM x"""


# posts as they are read and as they are told to others
def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.classify(P.posts(spark, sf_dir), "raw_text")


def event_location_rows(spark: SparkSession, sf_dir: str, parsed: DataFrame | None = None) -> DataFrame:
    """Classified posts are stored, as they are read for regions and for cities."""
    parsed = snapshots.written(_parsed(spark, sf_dir).select("post_id", "raw_text", "kind"), "parsed") if parsed is None else parsed
    found = parsed.where("kind = 'event'").select("post_id", "raw_text")
    cities = gazetteer.match_cities(found, "post_id", "raw_text", _cities(spark)).select("post_id", "rank", "name", F.lit("city").alias("kind"), F.lit(None).cast("string").alias("region_code"))
    return geo.location_rows(gazetteer.match_regions(found, "post_id", "raw_text", P.regions(spark)), cities, "post_id")


def event_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = snapshots.written(_parsed(spark, sf_dir).select("post_id", "raw_text", "kind", "posted_at"), "parsed")
    latest = _sorted(parsed.where("kind = 'event'").select("post_id", "posted_at"), [F.desc("posted_at"), F.desc("post_id")], 100)
    return tables.of_parents(event_location_rows(spark, sf_dir, parsed), latest, "post_id")


_LOCATIONS_SQL = f"""f AS ({FULL_SQL}), g AS ({REGION_MATCH_SQL}), ci AS ({_CITY_SQL}), ev AS (SELECT post_id FROM f WHERE kind = 'event'), n AS (SELECT post_id, max(rank) AS n FROM g GROUP BY post_id),
lo AS (SELECT post_id, rank, code AS region_code, name AS place_name, 'region' AS precision, 'db' AS source FROM g JOIN ev USING (post_id)
  UNION ALL SELECT ci.post_id, CAST(coalesce(n.n, 0) + ci.rank AS INTEGER), coalesce(g.code, 'unknown'), ci.name, 'city', 'db' FROM ci JOIN ev USING (post_id) LEFT JOIN n ON n.post_id = ci.post_id LEFT JOIN g ON g.post_id = ci.post_id AND g.rank = 1)"""


def parse_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parsed(spark, sf_dir).select("post_id", F.when(F.col("kind") == "event", "ok").otherwise("failed").alias("status"), "reason", F.col("posted_at").alias("created_at"))
    return _sorted(rows, [F.desc("created_at"), F.desc("post_id")], 200)


def pipeline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = snapshots.written(_parsed(spark, sf_dir), "parsed")
    n = event_location_rows(spark, sf_dir, parsed).groupBy("post_id").agg(F.count(F.lit(1)).alias("locations"))
    rows = parsed.join(n, "post_id", "left").withColumn("invoked", F.col("n").isNull()).withColumn("cache_hit", F.col("n").isNull() & (F.col("post_id") % 4 == 0))
    return events.parse_events(rows, "post_id", "posted_at")


_EVENTS_SQL = f"""WITH {_LOCATIONS_SQL}, c AS (SELECT post_id, count(*) AS k FROM lo GROUP BY post_id), e AS (SELECT f.*, coalesce(k, 0) AS k, kind = 'event' AS e FROM f LEFT JOIN c USING (post_id)),
s AS (SELECT post_id, list_filter([CASE WHEN NOT e THEN ['MessageParseFailed', '{{"reason":"' || coalesce(reason, 'not_event') || '"}}'] END, CASE WHEN e AND n IS NULL THEN ['EnricherInvoked', '{{"provider":"unknown"}}'] END,
  CASE WHEN e AND n IS NULL AND post_id % 4 = 0 THEN ['EnricherCacheHit', '{{"provider":"unknown"}}'] END, CASE WHEN e AND k = 0 THEN ['EnricherFailed', '{{"reason":"no_location_candidates"}}'] END,
  CASE WHEN e THEN ['MessageParsed', '{{"eventType":"' || event_type || '","severity":"' || severity || '"}}'] END], lambda x: x IS NOT NULL) AS l FROM e),
u AS (SELECT post_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS x FROM s)
SELECT post_id, pos, sha256(concat_ws('/', x[1], 'raw_message', CAST(post_id AS VARCHAR), x[2])) AS id, x[1] AS type, 1 AS version, ts AS occurred_at, 'raw_message' AS aggregate_type, CAST(post_id AS VARCHAR) AS aggregate_id, x[2] AS payload
FROM u JOIN events ON event_id = post_id"""


def status_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.top_per_key(D.history(spark, sf_dir), ["place_id"], [F.desc("event_at"), F.desc("event_id")], 5)


def alias_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = D._t(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS alias", "'auto' AS source", "c_custkey % 3 <> 0 AS is_active", "CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS deprecated_at")
    new = D._t(spark, sf_dir, "orders").selectExpr("o_custkey * 2 AS id", "o_orderpriority AS alias", "'manual' AS source", "o_orderkey AS seq")
    return tables.upsert_aliases(base, new, ["id"], [F.desc("seq")])


def status_deactivate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.delete_keys(D._t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), D._t(spark, sf_dir, "customer").where("c_custkey % 4 = 0").selectExpr("c_custkey AS o_custkey"), ["o_custkey"])


def active_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D._t(spark, sf_dir, "nation").selectExpr("n_nationkey", "n_name", "n_nationkey % 6 <> 2 AS is_active")
    return _sorted(tables.active(rows).select("n_nationkey", "n_name"), ["n_name", "n_nationkey"], 500)


def audit_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = D._t(spark, sf_dir, "orders").selectExpr("o_orderkey AS run", "'running' AS status", "CAST(NULL AS TIMESTAMP_NTZ) AS finished_at")
    done = D._t(spark, sf_dir, "events").selectExpr("event_id AS run", "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status", "ts AS finished_at")
    return tables.finish(runs, done, "run")


_ASKED = "p_partkey, p_brand"


def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = D._t(spark, sf_dir, "part")
    cache = part.where("p_size % 5 = 0").selectExpr("p_brand", "p_partkey AS fetched_at", "p_name AS answer")
    return geo.cached_answers(part.select("p_partkey", "p_brand"), cache.where("fetched_at % 2 = 0 AND p_brand < 'Brand#4'"), "p_brand", "fetched_at").select("p_partkey", "answer", "cache_hit")


def location_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = D.contributions(spark, sf_dir).groupBy("place_id").agg(F.collect_set("provider").alias("p"))
    return sets.select("place_id", geo.location_source(F.col("p")).alias("source"))


QUERIES = {
    f.__name__: f
    for f in (
        place_dedupe, catalog_step, llm_region_lookup, place_link, alias_rows, diff_aliases, diff_sample, region_multikey, validate_api, event_location_rows, event_locations, parse_attempts, pipeline_events,
        status_history, alias_upsert, status_deactivate, active_regions, audit_finish, cached_answers, location_source,
    )
}

_NP = "trim(regexp_replace(regexp_replace(replace(lower(name), 'ё', 'е'), '[\"''`]', '', 'g'), '\\s+', ' ', 'g'))"
_W = lambda c: f"string_split(regexp_replace({c}, '\\s+', ' ', 'g'), ' ')[1]"
_LN = lambda c: f"trim(replace(lower({c}), 'ё', 'е'))"
ORACLE = {
    "place_dedupe": f"SELECT post_id, kind, {_NP} AS norm_name, min(ord) AS ord, arg_max(name, ord) AS name, max_by(lat_, ord) AS lat, arg_max(lon, ord) AS lon FROM (SELECT *, coalesce(lat, -1) AS lat_ FROM (SELECT {_NAMED} FROM part)) GROUP BY 1, 2, 3".replace("max_by(lat_, ord)", "nullif(arg_max(lat_, ord), -1)"),
    "llm_region_lookup": f"""WITH n AS (SELECT *, {_LN('name')} AS nn FROM (SELECT {_LLM} FROM part)), k AS (SELECT *, {_LN('name')} AS nn FROM (SELECT {_KNOWN} FROM part) WHERE ord % 3 <> 1),
m AS (SELECT n.node, arg_min(k.code, k.ord) AS hit FROM n JOIN k ON k.post_id = n.post_id AND (k.nn = n.nn OR {_W('k.nn')} = {_W('n.nn')}) WHERE n.kind = 'region' GROUP BY n.node)
SELECT node, coalesce(hit, own_code, answer_code, hint) AS region_code FROM n LEFT JOIN m USING (node)""",
    "place_link": f"WITH {_LINK_SQL} SELECT draft_key, place_id FROM li",
    "alias_rows": f"WITH {_ALIAS_SQL} SELECT * FROM ar",
    "diff_aliases": f"""WITH {_ALIAS_SQL}, e AS (SELECT concat_ws(':', target_kind, coalesce(region_id, CAST(place_id AS VARCHAR)), alias_norm) AS key, alias FROM ar),
c AS (SELECT 'place:' || c_custkey || ':' || {_N('c_name')} AS key, CASE WHEN c_custkey % 8 = 0 THEN upper(c_name) ELSE c_name END AS alias FROM customer WHERE c_custkey % 9 <> 0)
SELECT e.key, e.alias, CASE WHEN c.key IS NULL THEN 'added' WHEN e.alias = c.alias THEN 'noop' ELSE 'updated' END AS change FROM e LEFT JOIN c USING (key)""",
    "diff_sample": f"{D._DIFF} SELECT ord, key, change FROM d WHERE change <> 'noop' ORDER BY ord LIMIT 20",
    "region_multikey": f"""WITH c AS ({_CODES}), k AS (SELECT n_nationkey AS id, unnest([CASE WHEN n_nationkey % 2 = 0 THEN 'f' || n_nationkey END, 'I' || (n_nationkey % 20), 'region ' || (n_nationkey % 10)]) AS code FROM nation)
SELECT seq, min(id) AS region_id FROM c LEFT JOIN k USING (code) GROUP BY seq""",
    "validate_api": _API_SQL,
    "event_location_rows": f"WITH {_LOCATIONS_SQL} SELECT * FROM lo",
    "event_locations": f"WITH {_LOCATIONS_SQL} SELECT * FROM lo WHERE post_id IN (SELECT post_id FROM ev JOIN events ON event_id = post_id ORDER BY ts DESC, post_id DESC LIMIT 100)",
    "parse_attempts": f"WITH f AS ({FULL_SQL}) SELECT post_id, CASE WHEN kind = 'event' THEN 'ok' ELSE 'failed' END AS status, reason, ts AS created_at FROM f JOIN events ON event_id = post_id ORDER BY ts DESC, post_id DESC LIMIT 200",
    "pipeline_events": _EVENTS_SQL,
    "status_history": f"{D._HIST} SELECT *, CAST(row_number() OVER (PARTITION BY place_id ORDER BY event_at DESC, event_id DESC) AS INTEGER) AS rank FROM h QUALIFY rank <= 5",
    "alias_upsert": """WITH b AS (SELECT c_custkey AS id, c_name AS alias, c_custkey % 3 <> 0 AS act FROM customer), u AS (SELECT o_custkey * 2 AS id, arg_max(o_orderpriority, o_orderkey) AS alias FROM orders GROUP BY 1)
SELECT coalesce(u.id, b.id) AS id, coalesce(u.alias, b.alias) AS alias, CASE WHEN u.id IS NULL THEN 'auto' ELSE 'manual' END AS source, u.id IS NOT NULL OR act AS is_active, CASE WHEN u.id IS NULL AND NOT act THEN b.id END AS deprecated_at FROM b FULL JOIN u ON b.id = u.id""",
    "status_deactivate": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)",
    "active_regions": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 6 <> 2 ORDER BY n_name, n_nationkey LIMIT 500",
    "audit_finish": "SELECT o_orderkey AS run, CASE WHEN event_id IS NULL THEN 'running' WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, ts AS finished_at FROM orders LEFT JOIN events ON event_id = o_orderkey",
    "cached_answers": """WITH c AS (SELECT p_brand, arg_max(p_name, p_partkey) AS answer FROM part WHERE p_size % 5 = 0 AND p_partkey % 2 = 0 AND p_brand < 'Brand#4' GROUP BY p_brand)
SELECT p_partkey, answer, c.p_brand IS NOT NULL AS cache_hit FROM part LEFT JOIN c USING (p_brand)""",
    "location_source": f"WITH c AS (SELECT {D._CONTRIBUTION} FROM orders) SELECT place_id, CASE WHEN bool_or(provider = 'dadata') THEN 'dadata' WHEN bool_or(provider = 'nominatim') THEN 'nominatim' WHEN bool_or(provider = 'llm') THEN 'llm' ELSE 'db' END AS source FROM c GROUP BY place_id",
}
