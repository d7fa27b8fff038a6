"""Dictionary matching: names in posts by an equi-join on word n-grams, never by scanning every alias in every text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import city_haystack, norm_city, norm_place, norm_region, region_haystack, rx, squeeze, trim

# Type words, endings and line patterns of the matched names.
TYPE_WORDS = "обл|область|респ|республика|край|ао|автономный округ"
ENDINGS = ("скую", "ской", "ские", "ских")
DISTRICT = r"(?<![\p{L}\p{N}_])([а-яёА-ЯЁa-zA-Z][а-яёА-ЯЁa-zA-Z\-\s]{1,40}?\sрайон)(?![\p{L}\p{N}_])"
LEAD = r"^(?:бпла|бплаи?|угроза|опасность|внимание|фиксация|отбой)\s+(?:по\s+|на\s+)?"
PREPOSITION = r"^(?:по|на|в|во|к|из|от)\s+"
AIRPORT = r"аэропорт\s+([А-ЯЁ][а-яё-]{2,})"
PREFIXED = r"(?:^|[\s,;])(?:г\.|город)\s*([А-ЯЁ][а-яё-]{2,})"
NO_CITY_LINE = "область|край|республика|ао|район|бпла|пво|опасност|внимани|фиксац|отбой|ограничения|ивп|работа|сбит|угроза|меры|подписаться|обход|радар|@"
CITY = r"[А-ЯЁ][а-яё-]{2,}"
# End of fixed values.

#: Rows of a dictionary that are sent to all tasks at most, and that are looked up inside the row at most.
BROADCAST_ROWS, LITERALS = 200_000, 5_000


def alias_array(name: Column, full_name: Column) -> Column:
    """All forms under which a region is looked for."""

    def forms(value: Column) -> Column:
        full = norm_region(value)
        bare = trim(squeeze(F.regexp_replace(full, rf"(?:^| )({TYPE_WORDS})(?= |$)", " ")))
        stem = trim(F.regexp_replace(bare, "(ская|ский|ское|ские)$", ""))
        return F.array(full, bare, F.when(F.length(stem) >= 5, stem))

    base = F.array_distinct(F.array_compact(F.concat(F.coalesce(forms(name), F.array()), F.coalesce(forms(full_name), F.array()))))
    cases = F.transform(
        base,
        lambda a: F.when(a.endswith("ская"), F.array(a, *(F.concat(F.substr(a, F.lit(1), F.length(a) - 4), F.lit(e)) for e in ENDINGS))).otherwise(F.array(a)),
    )
    return F.filter(F.array_distinct(F.flatten(cases)), lambda a: a != "")


def region_aliases(regions: DataFrame) -> DataFrame:
    """(code, name, ord, alias) of regions(code, name, full_name, ord)."""
    return regions.select("code", F.coalesce("full_name", "name").alias("name"), "ord", F.explode(alias_array(F.col("name"), F.col("full_name"))).alias("alias"))


def match_names(posts: DataFrame, key: str, haystack: Column, aliases: DataFrame, carry: tuple[str, ...] = (), more: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry columns, code, name, position, alias, ord, more columns, rank) of each name in each text: its first place, there its longest alias.

    aliases: code, name, ord, alias, of any number of words, and the columns in more. Texts become word n-grams as long as the longest alias. A
    dictionary of up to LITERALS aliases is looked up inside the row: n-grams are built from words only that begin an alias,
    and a post costs a row per name in it; a larger dictionary meets all n-grams in a hash join. Names of a post are gathered
    once, by post; rank is by place, longest, ord.
    """
    words = F.split(haystack, " ")
    first_rows = aliases.select("alias").limit(LITERALS + 1).collect()
    inside, known = len(first_rows) <= LITERALS, {r[0] for r in first_rows}
    longest = max((len(a.split(" ")) for a in known), default=1) if inside else aliases.agg(F.max(F.size(F.split("alias", " ")))).first()[0]
    starts = F.transform("_w", lambda x, i: F.when(x.isin(sorted({a.split(" ")[0] for a in known})) if inside else F.lit(True), i)) if known else F.array().cast("array<int>")
    gram = lambda i, n: F.struct(i.alias("position"), F.array_join(F.slice("_w", i + 1, n), " ").alias("alias"))
    at = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("_w") - i)), lambda n: gram(i, n))
    grams = F.flatten(F.transform(F.array_compact(starts), (lambda i: F.filter(at(i), lambda g: g["alias"].isin(sorted(known)))) if inside else at))
    rows = len(first_rows) if inside else aliases.limit(BROADCAST_ROWS + 1).count()
    found = posts.select(key, *carry, words.alias("_w")).select(key, *carry, F.inline(grams))
    joined = found.join(F.broadcast(aliases) if rows <= BROADCAST_ROWS else aliases, "alias")
    one = F.struct("position", (-F.length("alias")).alias("length"), "ord", "code", "name", "alias", *more)
    of_post = joined.groupBy(key).agg(*(F.first(c).alias(c) for c in carry), F.array_sort(F.collect_list(one)).alias("_all"))
    # in this order the first entry of a code is its best
    codes = of_post.withColumn("_codes", F.transform("_all", lambda x: x["code"]))
    best = codes.withColumn("_best", F.filter("_all", lambda x, i: F.array_position("_codes", x["code"]) == i + 1))
    listed = best.select(key, *carry, F.posexplode("_best").alias("_i", "_b"))
    return listed.select(key, *carry, "_b.code", "_b.name", "_b.position", "_b.alias", "_b.ord", *(f"_b.{c}" for c in more), (F.col("_i") + 1).cast("int").alias("rank"))


def match_regions(posts: DataFrame, key: str, text: str, regions: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Regions named in each post, numbered from 1 in the order in which they appear."""
    return match_names(posts, key, region_haystack(F.col(text)), region_aliases(regions), carry).select(key, *carry, "code", "name", "rank")


def match_cities(posts: DataFrame, key: str, text: str, cities: DataFrame) -> DataFrame:
    """Cities of cities(name, lat, lon, ord) named in each post; of equal names the last entry counts, at the first one's place."""
    w = Window.partitionBy(F.lower("name"))
    entries = cities.withColumn("_last", F.max("ord").over(w)).withColumn("_first", F.min("ord").over(w)).where("ord = _last")
    aliases = entries.select(F.lower("name").alias("code"), "name", F.col("_first").alias("ord"), norm_city(F.col("name")).alias("alias"), "lat", "lon")
    found = match_names(posts, key, city_haystack(F.col(text)), aliases, more=("lat", "lon"))
    return found.select(key, "name", "lat", "lon", F.row_number().over(Window.partitionBy(key).orderBy("ord")).cast("int").alias("rank"))


def district_array(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(rx(DISTRICT)), F.lit(1))
    clean = F.transform(found, lambda x: trim(F.regexp_replace(F.regexp_replace(trim(x), rx(LEAD), ""), rx(PREPOSITION), "")))
    return F.filter(clean, lambda x: x != "")


def fallback_city_array(text: Column) -> Column:
    """Names that look like cities: after "airport", after a prefix, and on lines of names only; each once, in that order."""
    tidy = lambda x: trim(F.regexp_replace(x, "[.?!;:]", ""))
    named = lambda arr: F.filter(F.transform(arr, tidy), lambda x: x.rlike(CITY))
    airport = F.regexp_extract_all(text, F.lit(rx(AIRPORT)), F.lit(1))
    prefixed = F.regexp_extract_all(text, F.lit("(?m)" + rx(PREFIXED)), F.lit(1))
    lines = F.filter(F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), trim), lambda x: (x != "") & ~x.rlike(rx(NO_CITY_LINE)))
    plain = F.flatten(F.transform(lines, lambda x: F.split(x, ",")))
    return F.array_distinct(F.concat(named(airport), named(prefixed), named(plain)))


def dedupe_places(places: DataFrame, key: str) -> DataFrame:
    """One place per kind and normalised name of a post: the last entry's values at the first entry's position (ord)."""
    by = [key, "kind", norm_place(F.col("name")).alias("norm_name")]
    return places.groupBy(*by).agg(F.min("ord").alias("ord"), F.max_by(F.struct("name", "lat", "lon"), "ord").alias("v")).select(key, "kind", "norm_name", "ord", "v.*")
