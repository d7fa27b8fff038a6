"""Candidates of several providers merged into the regions and places of a post."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_merge

# Provider order, place kinds and what precision they give.
PROVIDERS = ("catalog", "llm", "dadata", "nominatim")
CITY_KINDS = ("city", "locality")
# End of fixed values.


def union_candidates(sources: dict[str, DataFrame]) -> DataFrame:
    """All providers' rows with provider and provider_ord, in the providers' fixed order."""
    out = None
    for i, p in enumerate(PROVIDERS):
        if p in sources:
            part = sources[p].withColumn("provider", F.lit(p)).withColumn("provider_ord", F.lit(i))
            out = part if out is None else out.unionByName(part)
    return out


def merge_places(candidates: DataFrame, key: str) -> DataFrame:
    """One place per post and normalised name, from rows (name, kind, region_code, fias_id, lat, lon, provider, provider_ord, ord) in order.

    The first kind, id and region that are there; the last full pair of coordinates; a name that begins with a capital
    replaces one that doesn't; the providers in order, one for each row.
    """
    order = F.struct("provider_ord", "ord")
    name = F.transform(F.array_sort(F.collect_list(F.struct("provider_ord", "ord", "name"))), lambda x: x["name"])
    head = lambda n: F.substr(n, F.lit(1), F.lit(1))
    best = F.aggregate(F.slice("_names", 2, 1 << 30), F.element_at("_names", 1), lambda a, n: F.when((head(a) == F.lower(head(a))) & (head(n) == F.upper(head(n))), n).otherwise(a))
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", order)).alias(c)
    both = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), order)
    merged = candidates.where("kind <> 'region'").groupBy(key, norm_merge(F.col("name")).alias("norm_name")).agg(
        name.alias("_names"), F.min_by("kind", order).alias("kind"), first("region_code"), first("fias_id"),
        F.coalesce(F.max_by("lat", both), F.min_by("lat", order)).alias("lat"), F.coalesce(F.max_by("lon", both), F.min_by("lon", order)).alias("lon"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("provider_ord", "ord", "provider"))), lambda x: x["provider"]), ",").alias("sources"),
    )
    return merged.withColumn("name", best).drop("_names")


def merge_regions(candidates: DataFrame, key: str) -> DataFrame:
    """Regions of a post, each code once: the first provider's row, codes compared in lower case without outer space."""
    code = F.lower(F.trim("region_code"))
    named = candidates.where((F.col("kind") == "region") & (F.coalesce(code, F.lit("")) != ""))
    first = lambda c: F.min_by(c, F.struct("provider_ord", "ord")).alias(c)
    return named.groupBy(key, code.alias("code")).agg(first("name"), first("provider"))


def _level(city: Column, coordinates: Column, district: Column) -> tuple[Column, Column]:
    """Label and value of what has any place or region: whether there is a city, coordinates, a district."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    level = F.when(yes(city) & yes(coordinates), 0).when(yes(city), 1).when(yes(district), 2).otherwise(3)
    label, value = ("locality_with_coords", "locality", "district", "region"), (1.0, 0.75, 0.5, 0.25)
    at = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), level + 1)
    return at(label), at(value)


def precision_of(places: Column, regions: Column) -> tuple[Column, Column]:
    """precision and completeness of a post from the lists of its places (kind, lat, lon) and regions, null where it has none."""
    label, value = _level(F.exists(places, lambda p: p["kind"].isin(*CITY_KINDS)), F.exists(places, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull()), F.exists(places, lambda p: p["kind"] == "district"))
    none = F.coalesce(F.size(places), F.lit(0)) + F.coalesce(F.size(regions), F.lit(0)) <= 0
    return F.when(none, "unknown").otherwise(label), F.when(none, 0.0).otherwise(value)


def precision(places: DataFrame, regions: DataFrame, key: str, posts: DataFrame | None = None) -> DataFrame:
    """(key, precision, completeness) of posts with any place or region; of all posts, if given: unknown and 0 without either."""
    city = F.col("kind").isin(*CITY_KINDS)
    p = places.groupBy(key).agg(F.bool_or(city).alias("c"), F.bool_or(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("x"), F.bool_or(F.col("kind") == "district").alias("d"))
    both = p.join(regions.select(key).distinct(), key, "full_outer")
    label, value = _level(F.col("c"), F.col("x"), F.col("d"))
    found = both.select(key, label.alias("precision"), value.alias("completeness"))
    if posts is None:
        return found
    return posts.select(key).distinct().join(found, key, "left").select(key, F.coalesce("precision", F.lit("unknown")).alias("precision"), F.coalesce("completeness", F.lit(0.0)).alias("completeness"))


def source_label(providers: Column) -> Column:
    """multi for more than one different provider, else that one, else local."""
    d = F.array_distinct(providers)
    return F.when(F.size(d) > 1, "multi").when(F.size(d) == 1, F.get(d, F.lit(0))).otherwise("local")


def first_answer(*answers: Column) -> Column:
    """The first provider's answer that isn't null; the providers after it are not asked (Spark evaluates them in turn)."""
    return F.coalesce(*answers)


def enrich_counts(providers: Column, locations: Column, cache_hit: Column) -> Column:
    """struct of invoked, hits, misses, cache_hit of a post's enrichment."""
    return F.struct(
        (F.size(providers) > 0).alias("invoked"), locations.cast("int").alias("hits"), F.when(locations > 0, 0).otherwise(1).alias("misses"), F.coalesce(cache_hit, F.lit(False)).alias("cache_hit")
    )
