"""Queries over posts: splitting, classification, extraction and dictionary matching, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import blocks, gazetteer, reports
from . import posts as P

_S = f"[{text.SPACE}]"
_P = f"WITH p AS ({P.posts_sql()})"


def _alt(patterns: tuple[str, ...]) -> str:
    return "(?i)" + "|".join(f"(?:{p.replace(chr(92) + 's', _S)})" for p in patterns)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{_S}+|{_S}+$', '', 'g')"


def _squeeze(c: str) -> str:
    return f"regexp_replace({c}, '{_S}+', ' ', 'g')"


def _lower(c: str) -> str:
    return f"replace(lower({c}), 'ё', 'е')"


def _strip(c: str) -> str:
    return f"array_to_string(list_filter(list_transform(string_split(replace({c}, chr(13), ''), chr(10)), lambda x: {_trim('x')}), lambda x: x <> '' AND NOT regexp_matches(x, {_q(_alt(rules.FOOTERS))})), chr(10))"


def _chain(c: str, table: tuple[tuple, ...], otherwise: str = "NULL") -> str:
    rows = " ".join(f"WHEN regexp_matches({c}, {_q(('(?is)' if len(r) > 2 and r[2] else '(?i)') + r[0].replace(chr(92) + 's', _S))}) THEN '{r[1]}'" for r in table)
    return f"CASE {rows} ELSE {otherwise} END"


_KIND = f"CASE WHEN {_trim('b')} = '' OR regexp_matches(b, {_q(_alt(rules.NOISE))}) THEN 'noise' WHEN regexp_matches(b, {_q(_alt(rules.META))}) THEN 'meta' WHEN regexp_matches(b, {_q(_alt(rules.HINTS))}) THEN 'event' ELSE 'noise' END"
_BODY = f"{_P}, s AS (SELECT *, {_strip('raw_text')} AS b FROM p)"
_COUNT = "coalesce(" + ", ".join(f"nullif(TRY_CAST(nullif(regexp_extract(b, {_q('(?i)' + p.replace(chr(92) + 's', _S))}, 1), '') AS BIGINT), 0)" for p in rules.COUNTS) + ")"
_NAMED = f"regexp_extract(b, {_q('(?i)в' + _S + '+направлении' + _S + '+([^' + chr(92) + 'n.]+)')}, 1)"
_DIRECTION = f"CASE WHEN {_NAMED} <> '' THEN {_trim(_NAMED)} WHEN regexp_matches(b, '(?i)в{_S}+вашем{_S}+направлении') THEN 'в вашем направлении' END"
_SEVERITY = f"CASE WHEN t = 'cleared' THEN 'info' ELSE {_chain('b', rules.SEVERITY, _q('info'))} END"
_CLASSIFIED = f"{_BODY}, k AS (SELECT *, {_KIND} AS k0, {_chain('b', rules.EVENT_RULES)} AS t FROM s), c AS (SELECT *, k0 = 'event' AND t IS NOT NULL AS e FROM k)"
_FULL = f"""SELECT post_id, channel_key, raw_text, CASE WHEN e THEN 'event' WHEN k0 = 'event' THEN 'noise' ELSE k0 END AS kind,
  CASE WHEN k0 = 'meta' THEN 'meta_content' WHEN k0 = 'noise' THEN 'noise_content' WHEN NOT e THEN 'event_type_not_detected' END AS reason,
  CASE WHEN e THEN t END AS event_type, CASE WHEN e THEN {_SEVERITY} END AS severity, CASE WHEN e THEN regexp_matches(b, '(?i)повторн|сохраняется') END AS repeat,
  CASE WHEN e THEN {_COUNT} END AS n, CASE WHEN e THEN {_DIRECTION} END AS direction, CASE WHEN e THEN {_chain('b', rules.ZONES)} END AS macro_zone FROM c"""
FULL_SQL = f"{_CLASSIFIED} {_FULL}"


def classified_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.classify(P.posts(spark, sf_dir).select("post_id", "channel_key", "raw_text"), "raw_text")


def _post(column):
    return lambda spark, sf: P.posts(spark, sf).select("post_id", column(F.col("raw_text")))


def _norm_region_sql(c: str) -> str:
    inner = f"regexp_replace(regexp_replace({_lower(c)}, '[\"''`]', '', 'g'), '[()]', ' ', 'g')"
    return _trim(_squeeze(inner))


_HAY = _trim(_squeeze(f"regexp_replace({_norm_region_sql('raw_text')}, '[,;:.!?()\\[\\]{{}}«»\"''–—−]', ' ', 'g')"))
_BARE = _trim(_squeeze(f"regexp_replace(' ' || f || ' ', ' ({gazetteer.TYPE_WORDS}) ', ' ', 'g')"))
_ALIASES = f"""r AS ({P.regions_sql()}), v AS (SELECT code, full_name AS name, ord, unnest([name, full_name]) AS x FROM r),
f AS (SELECT code, name, ord, {_norm_region_sql('x')} AS f FROM v), b AS (SELECT *, {_BARE} AS bare FROM f),
st AS (SELECT *, trim(regexp_replace(bare, '(ская|ский|ское|ские)$', '')) AS stem FROM b),
ba AS (SELECT code, name, ord, f AS a FROM st UNION SELECT code, name, ord, bare FROM st UNION SELECT code, name, ord, stem FROM st WHERE length(stem) >= 5),
al AS (SELECT DISTINCT code, name, ord, alias FROM (SELECT code, name, ord, a AS alias FROM ba UNION ALL
  SELECT code, name, ord, left(a, length(a) - 4) || unnest(['скую', 'ской', 'ские', 'ских']) FROM ba WHERE a LIKE '%ская') WHERE alias <> '')"""
REGION_MATCH_SQL = f"""{_P}, {_ALIASES}, h AS (SELECT post_id, ' ' || {_HAY} || ' ' AS hay FROM p),
m AS (SELECT post_id, code, name, ord, alias, instr(hay, ' ' || alias || ' ') AS place FROM h JOIN al ON contains(hay, ' ' || alias || ' ')),
o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY post_id, code ORDER BY place, length(alias) DESC) = 1)
SELECT post_id, code, name, CAST(row_number() OVER (PARTITION BY post_id ORDER BY place, length(alias) DESC, ord) AS INTEGER) AS rank FROM o"""


#: Customers as regions, in names of all forms that have aliases of their own.
_TABLE_REGIONS = (
    "CAST(c_custkey AS VARCHAR(20)) AS code;CASE c_custkey % 4 WHEN 0 THEN concat(c_mktsegment, 'ская') WHEN 1 THEN concat(c_name, ' (ский') WHEN 2 THEN concat('респ ', c_mktsegment, 'ское') ELSE c_mktsegment END AS name;"
    "CASE c_custkey % 5 WHEN 0 THEN concat('Респ ', c_name) WHEN 1 THEN concat(c_mktsegment, 'ская обл') WHEN 2 THEN concat('«', c_name, '»  автономный округ') WHEN 3 THEN 'край' ELSE concat(c_mktsegment, 'Ёская область') END AS full_name;CAST(c_custkey AS INTEGER) AS ord"
)


def region_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gazetteer.match_regions(P.posts(spark, sf_dir), "post_id", "raw_text", P.regions(spark))


CITIES = (("Калуга", 54.5, 36.2, 0), ("Орёл", 52.9, 36.0, 1), ("Брянск", 53.2, 34.3, 2), ("Тула", 54.2, 37.6, 3), ("тула", 54.1, 37.5, 4), ("Санкт-Петербург", 59.9, 30.3, 5))


def _cities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CITIES, "name string, lat double, lon double, ord int")


_CITY_NORM = lambda c: _trim(_squeeze(f"regexp_replace(regexp_replace({_lower(c)}, '[\"''`]', '', 'g'), '[_-]+', ' ', 'g')"))
_CITY_SQL = f"""{_P}, c AS (SELECT * FROM (VALUES {', '.join(f"({_q(n)}, {a}::DOUBLE, {b}::DOUBLE, {o})" for n, a, b, o in CITIES)}) t(name, lat, lon, ord)),
u AS (SELECT arg_max(name, ord) AS name, arg_max(lat, ord) AS lat, arg_max(lon, ord) AS lon, min(ord) AS ord FROM c GROUP BY lower(name)),
h AS (SELECT post_id, ' ' || {_trim(_squeeze(f"regexp_replace({_CITY_NORM('raw_text')}, '[,;:.!?()" + chr(92) + "[" + chr(92) + "]]', ' ', 'g')"))} || ' ' AS hay FROM p)
SELECT post_id, name, lat, lon, CAST(row_number() OVER (PARTITION BY post_id ORDER BY ord) AS INTEGER) AS rank FROM h JOIN u ON contains(hay, ' ' || {_CITY_NORM('name')} || ' ')"""


def _listed(column):
    return lambda spark, sf: P.posts(spark, sf).select("post_id", F.posexplode(column(F.col("raw_text"))).alias("pos", "name"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts by region and type: posts are classified, and the regions that events name are matched, in one scan."""
    events = classified_posts(spark, sf_dir).where("kind = 'event'")
    named = gazetteer.match_regions(events, "post_id", "raw_text", P.regions(spark), carry=("event_type", "n"))
    return named.groupBy("code", "event_type").agg(F.count(F.lit(1)).alias("posts"), F.sum("n").alias("objects"), F.min("post_id").alias("first_post"))


def snap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.kind_counts(classified_posts(spark, sf_dir), "channel_key")


def _city_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gazetteer.match_cities(P.posts(spark, sf_dir), "post_id", "raw_text", _cities(spark))


def gap_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.gap_totals(classified_posts(spark, sf_dir), region_match(spark, sf_dir), _city_match(spark, sf_dir))


def gap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.gap_rows(classified_posts(spark, sf_dir), region_match(spark, sf_dir), _city_match(spark, sf_dir))


_MENTIONS = f"""m0 AS (SELECT post_id, list_filter(list_transform(regexp_split_to_array(raw_text, '[' || chr(10) || ',;|]+'), lambda x: {_trim(_squeeze('x'))}), lambda x: x <> '' AND regexp_matches(x, {_q(reports.REGION_LIKE_SQL)})) AS parts,
 list_filter(list_transform(string_split(raw_text, chr(10)), lambda x: {_trim(_squeeze('x'))}), lambda x: x <> '' AND length(x) <= 120 AND regexp_matches(x, {_q(reports.REGION_LIKE_SQL)})) AS ln FROM p),
mm AS (SELECT post_id, list_concat(parts, list_filter(ln, lambda x: NOT list_contains(parts, x))) AS l FROM m0),
mx AS (SELECT DISTINCT post_id, x AS mention FROM (SELECT post_id, unnest(l) AS x FROM mm))"""
_NGEO = lambda c: f"trim(regexp_replace({_lower(c)}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

QUERIES = {
    "flagship_region_threat_counts": flagship,
    "split_blocks": lambda s, d: blocks.split_blocks(P.exports(s, d)),
    "strip_footer": _post(lambda c: rules.strip_footer(c).alias("body")),
    "classify_kind": _post(lambda c: rules.content_kind(rules.strip_footer(c)).alias("kind")),
    "event_type_rules": _post(lambda c: rules.event_type(rules.strip_footer(c)).alias("event_type")),
    "severity": _post(lambda c: rules.severity(rules.strip_footer(c), rules.event_type(rules.strip_footer(c))).alias("severity")),
    "extract_count": _post(lambda c: rules.count_of(rules.strip_footer(c)).alias("n")),
    "extract_direction": _post(lambda c: rules.direction(rules.strip_footer(c)).alias("direction")),
    "macro_zone": _post(lambda c: rules.macro_zone(rules.strip_footer(c)).alias("macro_zone")),
    "repeat_flag": _post(lambda c: rules.repeat_flag(rules.strip_footer(c)).alias("repeat")),
    "classify_full": lambda s, d: classified_posts(s, d).drop("raw_text", "channel_key"),
    "normalize_geo": lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", text.norm_geo(F.concat_ws(" Ё-", "p_name", "p_brand")).alias("norm")),
    "normalize_variants": _post(lambda c: F.concat_ws("|", text.norm_geo(c), text.norm_lookup(c), text.norm_merge(c), text.norm_region(c), text.norm_city(c), text.norm_place(c), text.norm_alias(c)).alias("norms")),
    "text_preview": _post(lambda c: text.preview(c).alias("preview")),
    "content_hash": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("content_hash")),
    "message_hash": lambda s, d: P.posts(s, d).select("post_id", reports.message_hash(F.col("channel_key"), F.col("message_id"), F.when(F.col("post_id") % 3 == 0, F.col("posted_at").cast("string"))).alias("hash")),
    "alias_expand": lambda s, d: gazetteer.region_aliases(s.read.parquet(f"{d}/customer.parquet").selectExpr(*_TABLE_REGIONS.split(";"))),
    "region_match": region_match,
    "city_match": _city_match,
    "districts": _listed(gazetteer.district_array),
    "fallback_cities": _listed(gazetteer.fallback_city_array),
    "region_mentions": lambda s, d: P.posts(s, d).select("post_id", F.explode(reports.region_mentions(F.col("raw_text"))).alias("mention")),
    "lost_mentions": lambda s, d: reports.lost_mentions(P.posts(s, d), region_match(s, d)),
    "snap_summary": snap_summary,
    "gap_totals": gap_totals,
    "gap_rows": gap_rows,
    "metrics_by_type": lambda s, d: classified_posts(s, d).where("kind = 'event'").groupBy("event_type").agg(F.count(F.lit(1)).alias("posts")),
    "flat_report": lambda s, d: reports.flat(classified_posts(s, d), region_match(s, d)),
}

_F = lambda e: f"{_BODY} SELECT post_id, {e} FROM s"
ORACLE = {
    "flagship_region_threat_counts": f"""WITH f AS ({FULL_SQL}), g AS ({REGION_MATCH_SQL})
SELECT code, event_type, count(*) AS posts, CAST(sum(n) AS BIGINT) AS objects, min(post_id) AS first_post FROM f JOIN g USING (post_id) WHERE kind = 'event' GROUP BY code, event_type""",
    "split_blocks": f"""WITH x AS ({P.exports_sql()}), t AS (SELECT file, {_trim("replace(text, chr(13), '')")} AS t FROM x),
h AS (SELECT file, t, regexp_matches(t, '(^|\\n)[^\\n]+, \\[\\d{{2}}\\.\\d{{2}}\\.\\d{{4}} \\d{{2}}:\\d{{2}}\\](\\n|$)') AS hd FROM t),
l AS (SELECT file, hd, string_split(CASE WHEN hd THEN regexp_replace(t, '(^|\\n)([^\\n]+, \\[\\d{{2}}\\.\\d{{2}}\\.\\d{{4}} \\d{{2}}:\\d{{2}}\\](?:\\n|$))', '\\1' || chr(1) || '\\2', 'g') ELSE regexp_replace(t, '\\n{{2,}}', chr(1), 'g') END, chr(1)) AS parts FROM h),
k AS (SELECT file, list_filter(list_transform(parts, lambda x: {_trim('x')}), lambda x: x <> '') AS parts FROM l)
SELECT file, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS index, unnest(parts) AS raw_text FROM k""",
    "strip_footer": _F("b AS body"),
    "classify_kind": _F(f"{_KIND} AS kind"),
    "event_type_rules": _F(f"{_chain('b', rules.EVENT_RULES)} AS event_type"),
    "severity": f"{_BODY}, k AS (SELECT *, {_chain('b', rules.EVENT_RULES)} AS t FROM s) SELECT post_id, {_SEVERITY} AS severity FROM k",
    "extract_count": _F(f"{_COUNT} AS n"),
    "extract_direction": _F(f"{_DIRECTION} AS direction"),
    "macro_zone": _F(f"{_chain('b', rules.ZONES)} AS macro_zone"),
    "repeat_flag": _F("regexp_matches(b, '(?i)повторн|сохраняется') AS repeat"),
    "classify_full": f"SELECT * EXCLUDE (raw_text, channel_key) FROM ({FULL_SQL})",
    "normalize_geo": f"SELECT p_partkey, {_NGEO('p_name || ' + _q(' Ё-') + ' || p_brand')} AS norm FROM part",
    "normalize_variants": f"""{_P}, n AS (SELECT post_id, {_lower('raw_text')} AS l, raw_text FROM p) SELECT post_id, concat_ws('|', trim(regexp_replace(l, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')),
 regexp_replace({_trim('l')}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), {_trim(_squeeze('l'))}, {_norm_region_sql('raw_text')}, {_CITY_NORM('raw_text')},
 {_trim(_squeeze("regexp_replace(l, '[" + chr(34) + "''`]', '', 'g')"))}, {_trim('lower(raw_text)')}) AS norms FROM n""",
    "text_preview": f"{_P} SELECT post_id, array_to_string(string_split(raw_text, chr(10))[1:3], ' | ') AS preview FROM p",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "message_hash": f"""{_P} SELECT post_id, sha256('{{"c":"' || channel_key || '","m":' || message_id || ',"e":' || CASE WHEN post_id % 3 = 0 THEN '"' || strftime(posted_at, '%Y-%m-%d %H:%M:%S') || CASE WHEN microsecond(posted_at) % 1000000 <> 0 THEN '.' || rtrim(lpad(CAST(microsecond(posted_at) % 1000000 AS VARCHAR), 6, '0'), '0') ELSE '' END || '"' ELSE 'null' END || '}}') AS hash FROM p""",
    "alias_expand": f"WITH {_ALIASES.replace(P.regions_sql(), 'SELECT ' + _TABLE_REGIONS.replace(';', ',') + ' FROM customer')} SELECT code, name, ord, alias FROM al",
    "region_match": REGION_MATCH_SQL,
    "city_match": _CITY_SQL,
    "region_mentions": f"{_P}, {_MENTIONS} SELECT post_id, mention FROM mx",
    "lost_mentions": f"""{_P}, {_MENTIONS}, g AS ({REGION_MATCH_SQL})
SELECT post_id, mention FROM mx WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.post_id = mx.post_id AND (contains({_NGEO('mention')}, {_NGEO('name')}) OR contains({_NGEO('name')}, {_NGEO('mention')})))""",
    "snap_summary": f"""WITH f AS ({FULL_SQL}) SELECT channel_key, count(*) AS total, count(*) FILTER (kind = 'event') AS events, count(*) FILTER (kind = 'noise') AS noise, count(*) FILTER (kind = 'meta') AS meta,
 round(CAST(count(*) FILTER (kind = 'event') AS DOUBLE) / count(*), 4) AS event_share FROM f GROUP BY channel_key""",
    "gap_totals": f"""WITH f AS ({FULL_SQL}), p AS ({P.posts_sql()}), {_MENTIONS}, g AS ({REGION_MATCH_SQL}), n AS (SELECT post_id, count(*) AS regions FROM g GROUP BY post_id), ct AS ({_CITY_SQL}), pl AS (SELECT post_id, count(*) AS places FROM ct GROUP BY post_id),
c AS (SELECT post_id, count(*) AS mentions FROM mx GROUP BY post_id)
SELECT count(DISTINCT channel_key) AS files, count(*) AS blocks, count(*) FILTER (kind = 'event') AS event, count(*) FILTER (kind = 'noise') AS noise, count(*) FILTER (kind = 'meta') AS meta,
 count(*) FILTER (regions IS NULL) AS unknown_geo, count(*) FILTER (kind = 'event' AND regions IS NULL) AS event_unknown_geo,
 count(*) FILTER (kind = 'event' AND mentions >= 2) AS multi_region_like, count(*) FILTER (kind = 'event' AND mentions >= 2 AND coalesce(places, 0) <= 1) AS multi_region_collapsed,
 count(*) FILTER (reason = 'event_type_not_detected') AS type_not_detected FROM f LEFT JOIN n USING (post_id) LEFT JOIN pl USING (post_id) LEFT JOIN c USING (post_id)""",
    "gap_rows": f"""WITH f AS ({FULL_SQL}), p AS ({P.posts_sql()}), {_MENTIONS}, g AS ({REGION_MATCH_SQL}), n AS (SELECT post_id, count(*) AS regions FROM g GROUP BY post_id), ct AS ({_CITY_SQL}), pl AS (SELECT post_id, count(*) AS places FROM ct GROUP BY post_id),
c AS (SELECT post_id, count(*) AS mentions, string_agg(mention, '|' ORDER BY mention) AS said FROM mx GROUP BY post_id), nm AS (SELECT post_id, name FROM g UNION SELECT post_id, name FROM ct), rs AS (SELECT post_id, string_agg(name, '|' ORDER BY name) AS resolved FROM nm GROUP BY post_id),
l AS (SELECT post_id, string_agg(mention, '|' ORDER BY mention) AS lost FROM mx WHERE NOT EXISTS (SELECT 1 FROM nm WHERE nm.post_id = mx.post_id AND (contains({_NGEO('mention')}, {_NGEO('name')}) OR contains({_NGEO('name')}, {_NGEO('mention')}))) GROUP BY post_id),
a AS (SELECT f.*, coalesce(regions, 0) AS regions, coalesce(places, 0) AS places, coalesce(mentions, 0) AS m, coalesce(said, '') AS mentions, coalesce(resolved, '') AS resolved, coalesce(lost, '') AS lost
 FROM f LEFT JOIN n USING (post_id) LEFT JOIN pl USING (post_id) LEFT JOIN c USING (post_id) LEFT JOIN rs USING (post_id) LEFT JOIN l USING (post_id)),
i AS (SELECT *, 'event_with_unknown_geo' AS issue FROM a WHERE kind = 'event' AND regions = 0 UNION ALL SELECT *, 'multi_region_collapsed_to_single_target' FROM a WHERE kind = 'event' AND m >= 2 AND places <= 1 UNION ALL SELECT *, 'event_type_not_detected' FROM a WHERE reason = 'event_type_not_detected')
SELECT post_id, issue, event_type, array_to_string(string_split(raw_text, chr(10))[1:3], ' | ') AS preview, raw_text, regions, places, mentions, resolved, lost FROM i""",
    "metrics_by_type": f"WITH f AS ({FULL_SQL}) SELECT event_type, count(*) AS posts FROM f WHERE kind = 'event' GROUP BY event_type",
    "flat_report": f"""WITH f AS ({FULL_SQL}), g AS ({REGION_MATCH_SQL}) SELECT post_id AS index, kind, coalesce(reason, '') AS reason, coalesce(event_type, '') AS event_type, coalesce(severity, '') AS severity,
 coalesce(n, 0) AS count, coalesce(code, '') AS region_code, CASE WHEN code IS NULL THEN 'unknown' ELSE 'region' END AS precision, 'local' AS source FROM f LEFT JOIN (SELECT * FROM g WHERE rank = 1) USING (post_id)""",
}
