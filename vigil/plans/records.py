"""Queries over stored records: upserts by several identities, merges into stored places, versioned tables; DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import identity, integrity, providers, status, trust, validation
from ..sources import snapshots
from ..streaming.status import with_locations
from .domain import _CONTRIBUTION, _HISTORY, _NORM, _SCORED_SQL, _split, _t, history

# regions: suppliers are stored, customers arrive; ids meet inside small blocks of numbers
_REGION_COLS = ("fias_id", "iso", "code", "name", "district")
_REGIONS = "s_suppkey AS id, CASE WHEN s_suppkey % 3 <> 0 THEN concat('f', CAST(s_suppkey - s_suppkey % 6 AS VARCHAR(20)), CAST(s_suppkey % 2 AS VARCHAR(9))) END AS fias_id, CASE WHEN s_suppkey % 4 = 1 THEN concat('i', CAST(s_suppkey AS VARCHAR(20))) END AS iso, CAST(NULL AS VARCHAR(9)) AS code, concat('n', CAST(s_suppkey AS VARCHAR(20))) AS name, CAST(s_nationkey AS VARCHAR(9)) AS district"
_DRAFTS = "c_custkey AS ord, c_custkey + 1000000000 AS id, CASE WHEN c_custkey % 2 = 0 THEN concat('f', CAST(c_custkey - c_custkey % 6 AS VARCHAR(20)), CAST(c_custkey % 4 AS VARCHAR(9))) WHEN c_custkey % 9 = 0 THEN '' END AS fias_id, CASE WHEN c_custkey % 5 = 0 THEN concat('i', CAST(c_custkey - c_custkey % 10 + 1 AS VARCHAR(20))) END AS iso, CASE WHEN c_custkey % 3 <> 0 THEN concat('i', CAST(c_custkey AS VARCHAR(20))) END AS code, concat('n', CAST(c_custkey + CASE WHEN c_custkey % 7 = 3 THEN 1 ELSE 0 END AS VARCHAR(20))) AS name, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS district"
_REGION_KEYS = {"fias": ["fias_id"], "iso": ["coalesce(iso, code)"], "name": ["name"]}

# places: most customers are stored, all arrive; names differ in signs and letters that are no part of a name
_PLACE_COLS = ("fias_id", "region_id", "kind", "name", "segment")
_PLACE = "c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN concat('p', CAST(c_custkey AS VARCHAR(20))) END AS fias_id, c_nationkey AS region_id, 'locality' AS kind, c_name AS name, c_mktsegment AS segment"
_ARRIVING = "c_custkey AS ord, c_custkey + 1000000000 AS id, CASE WHEN c_custkey % 3 = 0 THEN concat('p', CAST(c_custkey + CASE WHEN c_custkey % 6 = 0 THEN 25 ELSE 0 END AS VARCHAR(20))) END AS fias_id, c_nationkey AS region_id, CASE WHEN c_custkey % 8 = 7 THEN 'city' ELSE 'locality' END AS kind, concat(' ', replace(upper(c_name), '#', ' - ')) AS name, CASE WHEN c_custkey % 4 <> 2 THEN c_name END AS segment"
_PLACE_KEYS = {"fias": ["fias_id"], "natural": ["CAST(region_id AS VARCHAR)", "kind", _NORM("name")]}


def _regions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    stored, batch = _t(spark, sf_dir, "supplier").selectExpr(*_split(_REGIONS)), _t(spark, sf_dir, "customer").selectExpr(*_split(_DRAFTS))
    return identity.upsert_entities(stored, batch, identity.region_keys(), "ord", fill=("fias_id",))


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customer = _t(spark, sf_dir, "customer")
    stored, batch = customer.where("c_custkey % 4 <> 0").selectExpr(*_split(_PLACE)), customer.selectExpr(*_split(_ARRIVING))
    return identity.upsert_entities(stored, batch, identity.place_keys(), "ord")


def _upsert_sql(stored: str, batch: str, keys: dict[str, list[str]], columns: tuple[str, ...], fill: tuple[str, ...], what: str) -> str:
    key = " UNION ".join(f"SELECT rn, '{k}' || chr(0) || {' || chr(0) || '.join(p)} AS key FROM n WHERE " + " AND ".join(f"coalesce({x}, '') <> ''" for x in p) for k, p in keys.items())
    value = ", ".join(f"arg_max({c}, rn) FILTER ({c} IS NOT NULL) AS {c}" if c in fill else f"arg_max({{'v': {c}}}, rn).v AS {c}" for c in columns)
    cols = ", ".join(columns)
    return f"""WITH RECURSIVE s AS ({stored}), b AS ({batch}),
n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY late, ord, id) AS rn FROM (SELECT 0 AS late, 0 AS ord, id, {cols} FROM s UNION ALL SELECT 1, ord, id, {cols} FROM b)), k AS MATERIALIZED ({key}),
reach(a, z) AS (SELECT rn, rn FROM n UNION SELECT reach.a, y.rn FROM reach JOIN k AS x ON x.rn = reach.z JOIN k AS y ON y.key = x.key),
l AS (SELECT n.*, e.entity FROM n JOIN (SELECT a, min(z) AS entity FROM reach GROUP BY a) AS e ON e.a = n.rn),
g AS (SELECT entity, coalesce(min(id) FILTER (late = 0), arg_min(id, rn)) AS kept FROM l GROUP BY entity HAVING max(late) = 1),
t AS (SELECT l.*, kept FROM l JOIN g USING (entity))
""" + (
        f"SELECT kept AS id, {value} FROM t WHERE late = 1 OR id = kept GROUP BY entity, kept UNION ALL SELECT id, {cols} FROM l WHERE entity NOT IN (SELECT entity FROM g)"
        if what == "table"
        else "SELECT kept AS id, id AS other_id FROM t WHERE late = 0 AND id <> kept"
    )


# places with all fields, merged order by order: those of the first half of the numbers are stored, the rest arrives
_FIELD = {
    "name": "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END", "name_with_type": "CASE WHEN o_orderkey % 4 = 1 THEN concat('t', o_orderstatus) END", "kind": "CASE WHEN o_orderkey % 5 < 2 THEN o_orderstatus END",
    "parent_place_id": "CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + o_orderkey % 3 END", "fias_id": "CASE WHEN o_orderkey % 6 = 5 THEN concat('f', CAST(o_orderkey % 10 AS VARCHAR(9))) END",
    "kladr_id": "CASE WHEN o_orderkey % 11 = 2 THEN CAST(o_orderkey AS VARCHAR(20)) END", "oktmo": "CASE WHEN o_orderkey % 13 < 3 THEN '' END", "geometry_artifact_key": "CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END",
    "centroid_lat": "CASE WHEN o_orderkey % 4 <> 2 THEN CAST(o_orderkey % 90 AS DOUBLE) / 4 END", "centroid_lon": "CASE WHEN o_orderkey % 4 <> 2 THEN CAST(o_orderkey % 180 AS DOUBLE) / 8 END",
    "bbox": "CASE WHEN o_orderkey % 9 = 4 THEN concat('[', CAST(o_orderkey % 90 AS VARCHAR(9)), ']') END",
}
_ALL = ", ".join([*_split(_CONTRIBUTION)[:4], *(f"{e} AS {c}" for c, e in _FIELD.items())])
_LATE = "o_orderkey % 3 = 1"


def _contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").withColumn("late", F.expr(_LATE)).selectExpr(*_split(_ALL), "late")
    rows = rows.withColumn("score", trust.score_of(F.col("provider"), F.col("confidence")))
    rows = rows.withColumn("is_trusted", trust.is_trusted(F.col("provider"), F.col("score")))
    rows = rows.withColumn("state", trust.state_of(F.col("is_trusted"), F.col("score")))
    return rows.withColumn("seq", F.col("seq") + F.when(F.col("late"), 1_000_000_000_000).otherwise(0))


def _chunk() -> Column:
    return F.floor(F.col("seq") / 5000)


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _contributions(spark, sf_dir)
    stored = trust.combine(trust.summary(rows.where("not late and place_id % 10 <> 3"), trust.FIELDS), trust.FIELDS)
    return trust.fold_onto(snapshots.written(stored, "places"), rows.where("late"), chunk=_chunk())


def trust_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[0].withColumn("providers", F.array_join("providers", ","))


def trust_merge_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[1]


def _fold_sql(rows: str) -> str:
    """All contributions folded at once, with the rows that a filter leaves."""
    scored = _SCORED_SQL.replace(_CONTRIBUTION, _ALL).replace("o_orderkey AS seq", f"o_orderkey + CASE WHEN {_LATE} THEN 1000000000000 ELSE 0 END AS seq").replace("FROM orders", f"FROM orders WHERE {rows}")
    value = ", ".join(f"coalesce(arg_max({c}, seq) FILTER (accepted AND {c} IS NOT NULL), arg_min({c}, seq) FILTER ({c} IS NOT NULL)) AS {c}" for c in trust.FIELDS)
    return f"""{scored}, pv AS (SELECT place_id, list(provider ORDER BY f) AS providers FROM (SELECT place_id, provider, min(seq) AS f FROM k GROUP BY 1, 2) GROUP BY 1)
SELECT * FROM (SELECT place_id, {value}, max(score) AS score, bool_or(is_trusted) AS is_trusted, arg_max(state, list_position(['rejected', 'unverified', 'partially_verified', 'verified'], state)) AS state, count(*) AS n FROM k GROUP BY place_id) JOIN pv USING (place_id)"""


_EARLY = f"NOT ({_LATE}) AND o_custkey % 10 <> 3"


def _trust_merge_sql() -> str:
    names = {**{c: c for c in trust.FIELDS}, "trust_state": "state", "is_trusted": "is_trusted", "trust_score": "score", "evidence_providers": "providers"}
    changed = ", ".join(f"CASE WHEN a.{c} IS DISTINCT FROM e.{c} THEN '{n}' END" for n, c in names.items())
    every = ", ".join(f"a.{c}" for c in (*trust.FIELDS, "score", "is_trusted", "state", "n"))
    return f"""SELECT place_id, {every}, providers, CASE WHEN changed <> '' THEN changed || ',trust_updated_at' ELSE '' END AS applied
FROM (SELECT a.place_id, {every}, array_to_string(a.providers, ',') AS providers, concat_ws(',', {changed}) AS changed FROM ({_fold_sql('o_custkey % 10 <> 3')}) AS a JOIN ({_fold_sql(_EARLY)}) AS e ON e.place_id = a.place_id) AS a"""


# versioned tables: a cache keyed by query and provider, and an outbox, written in batches of which one comes twice
_CACHE = "concat('q', CAST(o_custkey % 50 AS VARCHAR(9))) AS query_norm, CASE o_orderkey % 3 WHEN 0 THEN 'dadata' WHEN 1 THEN 'nominatim' ELSE 'llm' END AS provider, o_orderstatus AS raw, o_orderkey AS fetched, o_orderkey % 4 AS batch"


def _cache(spark: SparkSession, sf_dir: str) -> tuple[str, list[int]]:
    rows, path = _t(spark, sf_dir, "orders").selectExpr(*_split(_CACHE)), snapshots.fresh_path(spark, "place-cache")
    put = lambda b: snapshots.put(rows.where(f"batch = {b}").drop("batch"), path, ["query_norm", "provider"], [F.desc("fetched")], keep=("raw",) if b == 3 else (), batch_id=str(b))
    return path, [put(b) for b in (0, 2, 1, 2, 3)]


def cache_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version after four batches, one of them sent again."""
    return snapshots.read(spark, _cache(spark, sf_dir)[0])


def cache_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version after two batches, read when there are four."""
    return snapshots.read(spark, _cache(spark, sf_dir)[0], 2)


def outbox_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = _t(spark, sf_dir, "events").selectExpr("event_id", "event_type AS type", "ts AS occurred_at"), snapshots.fresh_path(spark, "outbox")
    for b in (0, 1, 1, 2, 0):
        snapshots.append(rows.where(f"event_id % 3 = {b}"), path, batch_id=str(b), rows_per_file=100_000)
    return snapshots.read(spark, path)


def _cache_sql(batches: str, keep: bool) -> str:
    # the last batch that has a key wins, and in it the latest answer; batch 3 leaves raw as it was
    order = "CASE batch WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 3 END"
    raw = f"CASE WHEN count(*) FILTER (batch <> 3) > 0 THEN arg_max(raw, ({order}, fetched)) FILTER (batch <> 3) ELSE arg_max(raw, fetched) END" if keep else f"arg_max(raw, ({order}, fetched))"
    return f"SELECT query_norm, provider, {raw} AS raw, arg_max(fetched, ({order}, fetched)) AS fetched FROM (SELECT {_CACHE} FROM orders) WHERE batch IN ({batches}) GROUP BY query_norm, provider"


# states at many moments: every order asks for a place and a status; events with locations that come a while later
_ASKED = "o_orderkey AS q, o_custkey % 15 AS place_id, CASE o_orderkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'purchase' WHEN 2 THEN 'error' WHEN 3 THEN 'signup' ELSE 'none' END AS status_code, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * CAST(o_orderkey % 43200 AS INT) AS at"
_LOCATED = "event_id - event_id % 3 AS event_id, ts + INTERVAL '1' MINUTE * CAST(event_id % 90 AS INT) AS located_at, event_type AS place"


def status_at_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _t(spark, sf_dir, "orders").selectExpr(*_split(_ASKED)).withColumn("at", F.col("at").cast("timestamp_ntz"))
    return status.at_moments(history(spark, sf_dir), asked)


def located_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events")
    located = events.where("event_id % 4 <> 0").selectExpr(*_split(_LOCATED)).withColumn("located_at", F.col("located_at").cast("timestamp"))
    rows = with_locations(events.select("event_id", F.col("ts").cast("timestamp").alias("event_at"), "user_id"), located, "60 MINUTES")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("event_at", "located_at")})


# provider steps: parts as posts that ask for their type, a cache of some answers, and a stand-in that answers by the text's length
_ASKING = "p_partkey AS post_id, concat(CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE concat('  ', p_type) END, CASE WHEN p_size % 3 = 0 THEN concat(' ', p_brand) ELSE ' ' END) AS raw_text, CASE WHEN p_partkey % 3 <> 1 THEN CAST(p_size AS VARCHAR(9)) END AS region_code"


def stand_in() -> providers.Client:
    """A provider without a network: some questions it can't answer, some make it fail."""

    def client(rows: list[dict]) -> list[dict | None]:
        out = []
        for r in rows:
            n = len(r["raw_text"].strip())
            if n % 11 == 0:
                raise TimeoutError
            out.append(None if n % 5 == 0 else {"place_name": r["raw_text"].strip().lower()[:6] if n % 4 else None, "region_code": r["region_code"] if n % 3 else None, "place_fias": f"f{n}" if n % 2 else None, "lat": n / 2, "lon": -n / 4})
        return out

    return client


def _step(prefix: str, provider: str, fall_back: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        posts, cache = _t(spark, sf_dir, "part").selectExpr(*_split(_ASKING)), snapshots.fresh_path(spark, "answers")
        norm = F.concat(F.lit(prefix), providers.query_norm(F.col("raw_text")))
        held = posts.select(norm.alias("query_norm")).distinct().where(F.length("query_norm") % 7 == 0)
        held = held.selectExpr("query_norm", "'llm' AS provider", "'Cached' AS place_name", "CASE WHEN length(query_norm) % 2 = 0 THEN '77' END AS region_code", "'f' AS place_fias", "CAST(1 AS DOUBLE) AS lat", "CAST(2 AS DOUBLE) AS lon", "CAST(0.5 AS DOUBLE) AS confidence", "CAST(1 AS BIGINT) AS fetched_at")
        snapshots.put(held, cache, ["query_norm", "provider"], [F.desc("fetched_at")], batch_id="held")
        return providers.provider_step(posts, cache, stand_in, provider, 2, prefix, fall_back)

    return run


def _step_sql(prefix: str, fall_back: bool) -> str:
    own = "region_code" if fall_back else "NULL"
    return f"""WITH p AS (SELECT {_ASKING} FROM part), q AS (SELECT *, trim(lower(raw_text)) AS t, length('{prefix}' || trim(lower(raw_text))) AS k, length(trim(raw_text)) AS n FROM p),
f AS (SELECT t, min(post_id) AS asker, arg_min({{'r': region_code}}, post_id).r AS hint FROM q WHERE k % 7 <> 0 GROUP BY t)
SELECT post_id, TRUE AS cache_hit, 'Cached' AS name, 'locality' AS kind, CASE WHEN k % 2 = 0 THEN '77' ELSE coalesce(region_code, '') END AS region_code, 'f' AS fias_id, 1.0::DOUBLE AS lat, 2.0::DOUBLE AS lon FROM q WHERE k % 7 = 0
UNION ALL SELECT post_id, post_id <> asker, CASE WHEN n % 4 <> 0 THEN left(t, 6) ELSE t END, 'locality', CASE WHEN post_id <> asker THEN coalesce(CASE WHEN n % 3 <> 0 THEN hint END, region_code, '') ELSE coalesce(CASE WHEN n % 3 <> 0 THEN hint END, {own}) END,
 CASE WHEN n % 2 = 1 THEN 'f' || n END, n / 2::DOUBLE, -n / 4::DOUBLE FROM q JOIN f USING (t) WHERE k % 7 <> 0 AND n % 5 <> 0 AND n % 11 <> 0"""


# a graph of keys: nations hold customers, customers one another, orders and their lines hang on them
_GRAPH = (
    integrity.Edge("place", "region_id", "region", on_delete="cascade"), integrity.Edge("place", "parent_id", "place", on_delete="cascade"), integrity.Edge("alias", "place_id", "place", on_delete="cascade"),
    integrity.Edge("status", "alias_id", "alias", on_delete="cascade"), integrity.Edge("cache", "place_id", "place", on_delete="set null"), integrity.Edge("report", "place_id", "place"),
)
_GRAPH_TABLES = {
    "region": "n_nationkey AS id FROM nation", "place": "c_custkey AS id, c_nationkey AS region_id, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey + 1 END AS parent_id FROM customer",
    "alias": "o_orderkey AS id, CASE WHEN o_orderkey % 6 <> 0 THEN o_custkey END AS place_id FROM orders WHERE o_orderkey % 3 = 0", "status": "event_id AS id, event_id * 3 AS alias_id FROM events",
    "cache": "o_orderkey AS id, o_custkey AS place_id FROM orders WHERE o_orderkey % 3 = 1", "report": "o_orderkey AS id, o_custkey AS place_id FROM orders WHERE o_orderkey % 12 = 2",
}
_DOOMED = {"region": "id % 12 = 5", "place": "id % 50 = 7"}


def _graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    def table(sql: str) -> DataFrame:
        columns, source = sql.split(" FROM ")
        name, *where = source.split(" WHERE ")
        rows = _t(spark, sf_dir, name)
        return (rows.where(where[0]) if where else rows).selectExpr(*_split(columns))

    return {k: table(v) for k, v in _GRAPH_TABLES.items()}


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _graph(spark, sf_dir)
    return integrity.delete(tables, {t: tables[t].where(w) for t, w in _DOOMED.items()}, _GRAPH)


def dangling_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.dangling(_graph(spark, sf_dir), _GRAPH)


def _graph_sql(rest: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{t} AS (SELECT {v})" for t, v in _GRAPH_TABLES.items()) + rest


_CASCADE = """, gone AS (SELECT 'region' AS t, id FROM region WHERE id % 12 = 5 UNION SELECT 'place', id FROM place WHERE id % 50 = 7
 UNION (SELECT c.t, c.id FROM gone JOIN (SELECT 'place' AS t, id, 'region' AS pt, region_id AS p FROM place UNION ALL SELECT 'place', id, 'place', parent_id FROM place UNION ALL SELECT 'alias', id, 'place', place_id FROM alias
  UNION ALL SELECT 'status', id, 'alias', alias_id FROM status) AS c ON c.pt = gone.t AND c.p = gone.id))
SELECT t AS tbl, CAST(id AS VARCHAR) AS row, 'delete' AS effect FROM gone UNION ALL SELECT 'cache', CAST(id AS VARCHAR), 'clear place_id' FROM cache WHERE place_id IN (SELECT id FROM gone WHERE t = 'place')
UNION ALL SELECT 'report', CAST(id AS VARCHAR), 'block place_id' FROM report WHERE place_id IN (SELECT id FROM gone WHERE t = 'place')"""
_DANGLING = "".join(
    f"{' UNION ALL ' if i else ' '}SELECT '{e.child}' AS tbl, CAST(c.id AS VARCHAR) AS row, '{e.foreign}' AS column FROM {e.child} AS c WHERE {e.foreign} IS NOT NULL AND {e.foreign} NOT IN (SELECT id FROM {e.parent})" for i, e in enumerate(_GRAPH)
)


# match-or-create with its effects: customers are stored places, orders are candidates that name them by id, name or alias
_CANDIDATES = "o_orderkey AS seq, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_custkey % 3 AS VARCHAR(9)) END AS region_id, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat('Town ', CAST(o_custkey % 200 AS VARCHAR(9)), CASE WHEN o_orderkey % 4 = 0 THEN concat(' ', o_orderstatus) ELSE '' END) END AS name, CASE WHEN o_orderkey % 3 = 0 THEN concat('f', CAST(o_custkey % 150 AS VARCHAR(9))) END AS fias_id, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 90 AS DOUBLE) END AS lat, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 180 AS DOUBLE) END AS lon"


def _validated(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = _t(spark, sf_dir, "orders").selectExpr(*_split(_CANDIDATES), *_split(_CONTRIBUTION)[2:4])
    held = "c_custkey AS place_id, CAST(c_custkey % 3 AS VARCHAR(9)) AS region_id, concat('Town ', CAST(c_custkey AS VARCHAR(9))) AS name, CASE WHEN c_custkey % 2 = 0 THEN concat('f', CAST(c_custkey AS VARCHAR(9))) END AS fias_id, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon, CAST(c_custkey % 10 AS DOUBLE) / 10 AS score, c_custkey % 4 = 0 AS is_trusted, 'unverified' AS state, array('catalog') AS providers"
    customer = _t(spark, sf_dir, "customer").where("c_custkey <= 100")
    aliases = customer.where("c_custkey % 7 = 0").selectExpr("c_custkey AS place_id", "concat('town ', CAST(c_custkey + 100 AS VARCHAR(9))) AS alias_norm", "c_custkey AS ord")
    return validation.validate(rows, customer.selectExpr(*_split(held)), aliases)


def validate_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate's decision, with the evidence that it left."""
    out = _validated(spark, sf_dir)
    return out["decisions"].join(out["evidence"].drop("place_id"), "seq", "left")


QUERIES = {
    "validate_effects": validate_effects,
    "validate_places": lambda s, d: _validated(s, d)["places"].withColumn("providers", F.array_join("providers", ",")),
    "dadata_step": _step("", "dadata", False),
    "nominatim_step": _step("nominatim:", "nominatim", True),
    "status_at_events": status_at_events,
    "located_events": located_events,
    "cascade_delete": cascade_delete,
    "dangling_keys": dangling_keys,
    "region_upsert": lambda s, d: _regions(s, d)[0],
    "region_conflicts": lambda s, d: _regions(s, d)[1],
    "place_upsert": lambda s, d: _places(s, d)[0],
    "trust_merge": trust_merge,
    "trust_merge_missing": trust_merge_missing,
    "cache_put": cache_put,
    "cache_pinned": cache_pinned,
    "outbox_append": outbox_append,
}

_REGION_SQL = lambda what: _upsert_sql(f"SELECT {_REGIONS} FROM supplier", f"SELECT {_DRAFTS} FROM customer", _REGION_KEYS, _REGION_COLS, ("fias_id",), what)

ORACLE = {
    "dadata_step": _step_sql("", False),
    "nominatim_step": _step_sql("nominatim:", True),
    "status_at_events": f"""WITH h AS (SELECT place_id, status_code, event_at, arg_max(action, event_id) AS action FROM (SELECT {_HISTORY} FROM events) GROUP BY ALL), q AS (SELECT {_ASKED} FROM orders)
SELECT q.q, q.place_id, q.status_code, q.at, coalesce(h.action = 'activate', FALSE) AS is_active, CASE WHEN h.action = 'activate' THEN h.event_at END AS since
FROM q ASOF LEFT JOIN h ON q.place_id = h.place_id AND q.status_code = h.status_code AND q.at >= h.event_at""",
    "located_events": f"""WITH l AS (SELECT {_LOCATED} FROM events WHERE event_id % 4 <> 0) SELECT e.event_id, e.ts AS event_at, e.user_id, l.located_at, l.place
FROM events AS e LEFT JOIN l ON e.event_id = l.event_id AND l.located_at BETWEEN e.ts AND e.ts + INTERVAL 60 MINUTES""",
    "cascade_delete": _graph_sql(_CASCADE),
    "dangling_keys": _graph_sql(_DANGLING),
    "region_upsert": _REGION_SQL("table"),
    "region_conflicts": _REGION_SQL("conflicts"),
    "place_upsert": _upsert_sql(f"SELECT {_PLACE} FROM customer WHERE c_custkey % 4 <> 0", f"SELECT {_ARRIVING} FROM customer", _PLACE_KEYS, _PLACE_COLS, (), "table"),
    "trust_merge": _trust_merge_sql(),
    "trust_merge_missing": f"SELECT o_custkey AS place_id, count(*) AS n FROM orders WHERE {_LATE} AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE {_EARLY}) GROUP BY o_custkey",
    "cache_put": _cache_sql("0, 1, 2, 3", True),
    "cache_pinned": _cache_sql("0, 2", False),
    "outbox_append": "SELECT event_id, event_type AS type, ts AS occurred_at FROM events",
}
