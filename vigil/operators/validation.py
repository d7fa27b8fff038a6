"""Candidates matched or created in order, with all that each changes for those after it, solved as a fixpoint of joins.

One after the other, a candidate is looked up by official id, then by alias, then by name within its region, among places
as the candidates before it have left them: a match adds an alias and merges the candidate's values into the place, which
may give it another id or name; a candidate without a match becomes a place. Here all candidates get a place at once, what
they would do to the tables is laid out in time, all are looked up again as of their own moment, and this goes on until
nothing changes. What a round says of a candidate depends on earlier ones only, so the rounds settle the first one that was
wrong, and a state that a round leaves alone is that of the sequence.

Three things keep the rounds few and their work in proportion to the candidates. An id is claimed by a candidate only while
no place has it, so the candidates of one id are gone through in order within a round (a pass over sorted rows that holds the
places which have the id at that moment); only what other ids do to these places comes from the round before. An alias
depends on its first candidate alone. And a name is looked up by the first candidate of an alias alone, as all later ones find
the alias: four at most share a normalised name, so the moments of a name are joined with few. The rounds are as many as
the longest chain of claims, each of which takes the place of an id that the one before depended on, and of new aliases.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_geo, norm_lookup
from ..sources.snapshots import written
from . import trust
from .tables import first_per_key

FIELDS = ("name", "fias_id", "lat", "lon")


def _scored(candidates: DataFrame) -> DataFrame:
    rows = candidates.withColumn("score", trust.score_of(F.col("provider"), F.col("confidence")))
    rows = rows.withColumn("is_trusted", trust.is_trusted(F.col("provider"), F.col("score")))
    return rows.withColumn("state", trust.state_of(F.col("is_trusted"), F.col("score")))


def timeline(stored: DataFrame, placed: DataFrame) -> DataFrame:
    """What each row leaves behind: place_id, region_id, t, the fields as they are then (now_) and were before (was_), and what the
    row said.

    stored: places, at t -1; placed: valid candidates with place_id; the first row of a place that isn't stored creates it.
    """
    said = ("place_id", "region_id", "t", *FIELDS, "score", "is_trusted", "state", "provider")
    old = stored.withColumn("t", F.lit(-1).cast("long")).withColumn("provider", F.lit(None).cast("string")).select(*said)
    new = placed.withColumn("t", F.col("seq")).select(*said)
    by = Window.partitionBy("place_id").orderBy("t")
    before, upto = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, 0)
    score = F.coalesce("score", F.lit(0.0))
    rows = old.unionByName(new).withColumn("_fine", score >= F.coalesce(F.max(score).over(before), F.lit(0.0)))
    rows = rows.withColumns({f"_set_{c}": F.when(F.col(c).isNotNull() & (F.col("_fine") | (F.count(c).over(before) == 0)), F.col(c)) for c in FIELDS})
    rows = rows.withColumns({f"now_{c}": F.last(f"_set_{c}", ignorenulls=True).over(upto) for c in FIELDS} | {f"was_{c}": F.last(f"_set_{c}", ignorenulls=True).over(before) for c in FIELDS})
    # a place stays in the region that it was stored or created in
    return rows.withColumn("region_id", F.first("region_id").over(upto)).drop("_fine", *(f"_set_{c}" for c in FIELDS))


def _moments(stored: DataFrame, state: DataFrame) -> DataFrame:
    """What happens at each place in a state: place_id, t and either asks (an id) with takes (whether the place would take it), or
    lost (the id that it had until then), or called (its new name) with region_id, or several of these.

    A candidate asks where its alias leads. If it is placed elsewhere, it has a row at both, and the one that asks changes nothing.
    """
    asks, here, home = F.when(F.col("fias_id") != "", F.col("fias_id")), F.col("place_id") == F.col("known_as"), F.struct("region_id")
    changes = F.col("_k") == 1
    old = stored.select("place_id", F.lit(-1).cast("long").alias("t"), F.lit(1).alias("_k"), home.alias("_home"), "score", F.col("fias_id").alias("_id"), "name", F.lit(None).cast("string").alias("asks"))
    new = state.withColumn("_k", F.explode(F.when(asks.isNotNull() & ~here, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    new = new.select(
        F.when(changes, F.col("place_id")).otherwise(F.col("known_as")).alias("place_id"), F.col("seq").alias("t"), "_k", F.when(changes, home).alias("_home"), "score",
        F.when(changes & F.col("claims"), F.col("fias_id")).alias("_id"), F.when(changes, F.col("name")).alias("name"), F.when(~changes | here, asks).alias("asks"),
    )
    by = Window.partitionBy("place_id").orderBy("t", "_k")
    before, upto = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, 0)
    score = F.coalesce("score", F.lit(0.0))
    rows = old.unionByName(new).withColumn("_fine", score >= F.coalesce(F.max(F.when(changes, score)).over(before), F.lit(0.0)))
    rows = rows.withColumn("takes", F.col("_fine") | (F.count("_id").over(before) == 0))
    rows = rows.withColumns({"_id": F.when(F.col("takes"), F.col("_id")), "name": F.when(F.col("_fine") | (F.count("name").over(before) == 0), F.col("name"))})
    was = lambda c: F.last(c, ignorenulls=True).over(before)
    rows = rows.withColumns({"_had": was("_id"), "_called": was("name"), "region_id": F.first("_home", ignorenulls=True).over(upto)["region_id"]})
    lost = F.when(F.col("_id").isNotNull() & (F.col("_had") != F.col("_id")) & (F.col("_had") != ""), F.col("_had"))
    called = F.when(~F.col("name").eqNullSafe(F.col("_called")), F.col("name"))
    return rows.select("place_id", "t", "asks", "takes", lost.alias("lost"), "region_id", called.alias("called")).where("asks is not null or lost is not null or called is not null")


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, held) out of rows (id, t, what, place_id) in order of id and t: for each that asks the smallest place that has the id then.

    what: 0 the place has the id, 1 loses it, 2 asks, 3 asks and has it from then on if no place does. Holds the places of one id.
    """
    last, places, heap = None, set(), []
    for batch in batches:
        seq, held = [], []
        for key, t, what, place in zip(*(batch.column(c).to_pylist() for c in ("id", "t", "what", "place_id")), strict=True):
            if key != last:
                last, places, heap = key, set(), []
            while heap and heap[0] not in places:
                heapq.heappop(heap)
            if what == 1:
                places.discard(place)
            elif what == 0 or (what == 3 and not places):
                places.add(place)
                heapq.heappush(heap, place)
            elif places:
                seq.append(t)
                held.append(heap[0])
        yield pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(held, pa.int64())], ["seq", "held"])


def solve(candidates: DataFrame, stored: DataFrame, aliases: DataFrame, first_new: int) -> DataFrame:
    """Valid candidates with place_id; that of a candidate that creates a place is first_new + seq."""
    valid = candidates.where(F.col("region_id").isNotNull() & (F.coalesce("name", F.lit("")) != ""))
    valid = written(_scored(valid).withColumns({"_alias": norm_lookup(F.col("name")), "_name": norm_geo(F.col("name")), "own": (F.lit(first_new) + F.col("seq")).cast("long")}), "candidates")
    by_stored = first_per_key(aliases.where("place_id is not null").select(F.col("alias_norm").alias("_alias"), F.col("place_id").alias("_s"), "ord"), ["_alias"], ["ord", "_s"]).drop("ord")
    leader = written(valid.groupBy("_alias").agg(F.min("seq").alias("_j")).join(by_stored, "_alias", "left"), "aliases")
    # known_as: where the alias leads, for its first candidate the name or a place of its own; claims: no place had its id
    state = valid.join(leader, "_alias").withColumn("known_as", F.coalesce("_s", F.lit(first_new) + F.col("_j")).cast("long"))
    state = written(state.withColumns({"place_id": F.col("known_as"), "claims": F.col("fias_id") == "", "moved": F.lit(True)}), "placed")
    first = written(state.where("seq = _j and _s is null").select("seq", "region_id", "_name", "own"), "first")
    holders = stored.where("coalesce(fias_id, '') <> ''").select(F.col("fias_id").alias("id"), F.lit(-1).cast("long").alias("t"), F.lit(0).alias("what"), "place_id")
    while True:
        line = written(_moments(stored, state), "moments")
        asking = line.where("asks is not null").select(F.col("asks").alias("id"), "t", F.when(F.col("takes"), 3).otherwise(2).alias("what"), "place_id")
        losing = line.where("lost is not null").select(F.col("lost").alias("id"), "t", F.lit(1).alias("what"), "place_id")
        in_order = holders.unionByName(losing).unionByName(asking).repartition("id").sortWithinPartitions("id", "t")
        held = written(in_order.mapInArrow(_held, "seq long, held long"), "held")
        called = line.where("called is not null").withColumn("until", F.lead("t").over(Window.partitionBy("place_id").orderBy("t")))
        called = called.select("region_id", norm_geo(F.col("called")).alias("_name"), "t", "until", F.col("place_id").alias("_p"))
        standing = (F.col("t") < F.col("seq")) & (F.col("until").isNull() | (F.col("until") >= F.col("seq")))
        by_name = first.join(called, ["region_id", "_name"]).where(standing).groupBy("seq").agg(F.min("_p").alias("_n"))
        led = first.join(by_name, "seq", "left").join(held, "seq", "left").withColumn("_free", F.coalesce("_n", "own"))
        led = written(led.select(F.col("seq").alias("_j"), "_free", F.coalesce("held", "_free").alias("_l")), "led")
        rows = state.withColumnsRenamed({"place_id": "_place", "known_as": "_known", "claims": "_claims"}).join(held, "seq", "left").join(led, "_j", "left")
        rows = rows.withColumn("known_as", F.coalesce("_s", F.when(F.col("_j") < F.col("seq"), F.col("_l")).otherwise(F.col("_free"))))
        rows = rows.withColumns({"place_id": F.coalesce("held", "known_as"), "claims": F.col("fias_id").isNotNull() & F.col("held").isNull()})
        same = F.col("place_id").eqNullSafe(F.col("_place")) & F.col("known_as").eqNullSafe(F.col("_known")) & F.col("claims").eqNullSafe(F.col("_claims"))
        state = written(rows.withColumn("moved", ~same).select(*state.columns), "placed")
        if state.where("moved").isEmpty():
            return state.select(*valid.columns, "place_id")


def validate(candidates: DataFrame, stored: DataFrame, aliases: DataFrame, first_new: int = 1_000_000_000) -> dict[str, DataFrame]:
    """decisions, evidence, aliases and places after all candidates, taken in order of seq.

    candidates: seq (a number of its own each), region_id, name, fias_id, lat, lon, provider, confidence; stored: place_id
    (below first_new), region_id, name, fias_id, lat, lon, score, is_trusted (null counts as false), state, providers; aliases: place_id,
    alias_norm, ord. decisions: seq, decision (rejected, matched_existing, created_new), place_id; evidence: seq, place_id,
    provider, action (candidate, enrich, confirm), applied; aliases: (place_id, alias_norm, alias) that were set, the last
    text of each; places: all of them as they are in the end.
    """
    placed = solve(candidates, stored, aliases, first_new)
    line = written(timeline(stored, placed), "timeline")
    made = F.col("place_id") == F.col("own")
    decision = F.when(F.col("place_id").isNull(), "rejected").when(made, "created_new").otherwise("matched_existing")
    decisions = candidates.select("seq").join(placed.select("seq", "place_id", "own"), "seq", "left").select("seq", decision.alias("decision"), "place_id")
    by = Window.partitionBy("place_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.array_position(F.array(*(F.lit(s) for s in trust.STATES)), F.col("state"))
    grown = lambda c: F.coalesce(F.max(c).over(by), F.lit(0)) < c
    score = F.coalesce("score", F.lit(0.0))
    changed = [F.when(F.col(f"now_{c}").isNotNull() & ~F.col(f"now_{c}").eqNullSafe(F.col(f"was_{c}")), n) for c, n in zip(FIELDS, ("name", "fias_id", "centroid_lat", "centroid_lon"), strict=True)]
    changed += [F.when(grown(rank), "trust_state"), F.when(F.col("is_trusted") & ~F.coalesce(F.bool_or("is_trusted").over(by), F.lit(False)), "is_trusted"), F.when(score > F.coalesce(F.max(score).over(by), F.lit(0.0)), "trust_score")]
    changed += [F.when(F.col("_named"), "evidence_providers")]
    # a provider is new to a place with its first row there, unless it is stored with it
    own_row, kept = F.col("t") >= 0, stored.select("place_id", F.coalesce("providers", F.array().cast("array<string>")).alias("_kept"))
    at_first = F.row_number().over(Window.partitionBy("place_id", "provider", own_row).orderBy("t")) == 1
    stored_too = F.coalesce(F.exists("_kept", lambda x: x.eqNullSafe(F.col("provider"))), F.lit(False))
    rows = line.join(kept, "place_id", "left").withColumn("_named", own_row & at_first & ~stored_too)
    rows = rows.withColumn("_changed", F.array_compact(F.array(*changed))).where("t >= 0")
    created = F.col("place_id") == F.lit(first_new) + F.col("t")
    names = F.when(created, "").when(F.size("_changed") > 0, F.concat(F.array_join("_changed", ","), F.lit(",trust_updated_at"))).otherwise("")
    action = F.when(created, "candidate").when(F.size("_changed") > 0, "enrich").otherwise("confirm")
    evidence = rows.select(F.col("t").alias("seq"), "place_id", "provider", action.alias("action"), names.alias("applied"))
    set_aliases = placed.groupBy("place_id", F.col("_alias").alias("alias_norm")).agg(F.max_by("name", "seq").alias("alias"))
    places = line.groupBy("place_id").agg(
        F.first("region_id").alias("region_id"), *(F.max_by(F.struct(f"now_{c}"), "t")[f"now_{c}"].alias(c) for c in FIELDS), F.max("score").alias("score"),
        F.coalesce(F.bool_or("is_trusted"), F.lit(False)).alias("is_trusted"), F.max_by("state", rank).alias("state"),
    )
    known = kept.select("place_id", F.lit(-1).cast("long").alias("t"), F.posexplode("_kept").alias("_i", "provider"))
    known = known.unionByName(line.where(own_row).select("place_id", "t", F.lit(0).alias("_i"), "provider"))
    known = known.groupBy("place_id", "provider").agg(F.min(F.struct("t", "_i")).alias("_o")).groupBy("place_id")
    known = known.agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "provider"))), lambda x: x["provider"]).alias("providers"))
    places = places.join(known, "place_id", "left").withColumn("providers", F.coalesce("providers", F.array().cast("array<string>")))
    return {"decisions": decisions, "evidence": evidence, "aliases": set_aliases, "places": places}
