"""Places of a post: the catalog step, region codes of a language model's places, cached answers, and location rows."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze, trim
from . import gazetteer
from .tables import first_per_key

# Steps in their default order, what precision a kind of place gives, providers by how far they are believed.
STEPS = ("catalog", "llm", "dadata", "nominatim")
PRECISION = {"district": "district", "city": "city", "settlement": "settlement"}
BELIEVED = ("dadata", "nominatim", "llm")
# End of fixed values.


def step_order(value: str | None) -> tuple[str, ...]:
    """The steps that a comma-separated setting names; unknown ones are left out, and none means all in default order."""
    named = tuple(s for s in (x.strip().lower() for x in (value or "").split(",")) if s in STEPS)
    return named or STEPS


def run_steps(
    rows: DataFrame, steps: dict[str, Callable[[DataFrame], DataFrame]], order: tuple[str, ...], last: Callable[[DataFrame], DataFrame],
    stored: Callable[[DataFrame, str], DataFrame] | None = None, log: list[dict] | None = None,
) -> DataFrame:
    """rows through the steps in order, those that are there, and through `last` in the end.

    A step that fails is left out and the others go on with what was there before it. Spark runs a step when its rows are
    asked for; with `stored` (rows, name) they are, step by step, so that a failure in a task is the step's own too. log gets
    step, ok, ms and error of each.
    """
    for name in [s for s in order if s in steps]:
        began, error = time.monotonic(), None
        try:
            after = steps[name](rows)
            rows = after if stored is None else stored(after, name)
        except Exception as e:  # noqa: BLE001 - whatever a step raises is its own failure
            error = f"{type(e).__name__}: {e}"[:500]
        if log is not None:
            log.append({"step": name, "ok": error is None, "ms": int(1000 * (time.monotonic() - began)), "error": error})
    return last(rows)


def catalog_places(posts: DataFrame, key: str, text: str, regions: DataFrame, cities: DataFrame) -> DataFrame:
    """(key, ord, kind, name, lat, lon, region_code) of each post: districts, known cities, names that look like cities.

    Of one kind and normalised name the last entry's values stand at the first one's place. All are put into the post's
    first region; of a post without one only cities are kept.
    """
    t = F.col(text)
    none = F.lit(None).cast("double")
    entry = lambda kind, base: lambda x, i: F.struct((i + base).cast("int").alias("ord"), F.lit(kind).alias("kind"), x.alias("name"), none.alias("lat"), none.alias("lon"))
    # what the text itself says, in one list per post
    listed = F.filter(F.concat(F.transform(gazetteer.district_array(t), entry("district", 0)), F.transform(gazetteer.fallback_city_array(t), entry("city", 1 << 21))), lambda x: x["name"] != "")
    said = posts.select(key, F.inline(listed))
    known = gazetteer.match_cities(posts, key, text, cities).select(key, (F.col("rank") + (1 << 20)).cast("int").alias("ord"), F.lit("city").alias("kind"), "name", "lat", "lon")
    first = gazetteer.match_regions(posts, key, text, regions).where("rank = 1").select(key, F.col("code").alias("region_code"))
    return gazetteer.dedupe_places(said.unionByName(known), key).join(first, key, "left").where("region_code is not null or kind = 'city'").select(key, "ord", "kind", "name", "lat", "lon", "region_code")


def _name(c: Column) -> Column:
    return trim(F.replace(F.lower(c), F.lit("ё"), F.lit("е")))


def region_codes(nodes: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """nodes with region_code as it is after a language model's answer.

    nodes: key, name, kind, own_code, answer_code, hint; catalog: key, code, name, ord. A region takes the code of the first
    catalog region with its name or first word, else what the model says of the place, else of the whole answer, else the
    hint; other places skip the catalog. Two equi-joins, each on a table with one row per key.
    """
    word = lambda c: F.get(F.split(squeeze(c), " "), F.lit(0))
    known = catalog.select(key, "code", "ord", _name(F.col("name")).alias("_n"), word(_name(F.col("name"))).alias("_w"))
    by_name = first_per_key(known.select(key, "_n", F.struct("ord", "code").alias("_a")), [key, "_n"], ["_a"])
    by_word = first_per_key(known.select(key, "_w", F.struct("ord", "code").alias("_b")), [key, "_w"], ["_b"])
    rows = nodes.withColumn("_n", _name(F.col("name"))).withColumn("_w", word(F.col("_n"))).join(by_name, [key, "_n"], "left").join(by_word, [key, "_w"], "left")
    hit = F.when(F.col("kind") == "region", F.least("_a", "_b")["code"])
    return rows.withColumn("region_code", F.coalesce(hit, "own_code", "answer_code", "hint")).drop("_n", "_w", "_a", "_b")


def cached_answers(queries: DataFrame, cache: DataFrame, key: str, fetched: str) -> DataFrame:
    """queries with the columns of their latest cache row and cache_hit; only rows without a hit are left for a provider."""
    latest = first_per_key(cache, [key], [F.desc(fetched)]).withColumn("_hit", F.lit(True))
    return queries.join(latest, key, "left").withColumn("cache_hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def location_source(providers: Column) -> Column:
    """The most believed provider that took part, else db."""
    return reduce(lambda w, p: w.when(F.array_contains(providers, p), p), BELIEVED, F.when(F.lit(False), F.lit(None).cast("string"))).otherwise("db")


def place_precision(kind: Column) -> Column:
    return reduce(lambda w, k: w.when(kind == k, PRECISION[k]), PRECISION, F.when(F.lit(False), F.lit(None).cast("string"))).otherwise("locality")


def location_rows(regions: DataFrame, places: DataFrame, key: str, source: Column | None = None) -> DataFrame:
    """(key, rank, region_code, place_name, precision, source): a post's regions, then its places, in their first region where they have none."""
    first = regions.where("rank = 1").select(key, F.col("code").alias("_first"))
    n = regions.groupBy(key).agg(F.max("rank").alias("_n"))
    of_region = regions.select(key, F.col("rank").cast("int").alias("rank"), F.col("code").alias("region_code"), F.col("name").alias("place_name"), F.lit("region").alias("precision"), F.lit("db").alias("source"))
    at = places.join(first, key, "left").join(n, key, "left")
    return of_region.unionByName(
        at.select(
            key, (F.coalesce("_n", F.lit(0)) + F.col("rank")).cast("int").alias("rank"), F.coalesce("region_code", "_first", F.lit("unknown")).alias("region_code"),
            F.col("name").alias("place_name"), place_precision(F.col("kind")).alias("precision"), (F.lit("db") if source is None else source).alias("source"),
        )
    )
