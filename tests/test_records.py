"""Upserts by several identities, merges into stored places, versioned tables: held against sequential plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import graph, identity, integrity, trust
from vigil.sources import snapshots

REGION = "id long, fias_id string, iso string, code string, name string, district string"


def plain_upsert(stored, batch, fill=()):
    """Rows that share a key, found by merging sets; the last row of the batch wins."""
    keys = lambda r: {("f", r["fias_id"]), ("i", r["iso"] if r["iso"] is not None else r["code"]), ("n", r["name"])} - {(k, v) for k in "fin" for v in (None, "")}
    groups = []
    for r in [*({**r, "late": 0} for r in stored), *({**r, "late": 1} for r in batch)]:
        mine, rest = [[r], keys(r)], []
        for g in groups:
            if g[1] & mine[1]:
                mine = [g[0] + mine[0], g[1] | mine[1]]
            else:
                rest.append(g)
        groups = [*rest, mine]
    table, conflicts = [], []
    for rows, _ in groups:
        old, new = [r for r in rows if not r["late"]], [r for r in rows if r["late"]]
        if not new:
            table += old
            continue
        new.sort(key=lambda r: r["ord"])
        kept = min(old, key=lambda r: r["id"]) if old else None
        out = {**new[-1], "id": kept["id"] if kept else new[0]["id"]}
        for c in fill:
            out[c] = next((r[c] for r in [*reversed(new), *([kept] if kept else [])] if r[c] is not None), None)
        table.append(out)
        conflicts += [(out["id"], r["id"]) for r in old if r is not kept]
    return sorted(((r["id"], *(r[c] for c in ("fias_id", "iso", "code", "name", "district"))) for r in table), key=str), sorted(conflicts)


def upserted(spark, stored, batch, fill=()):
    s = spark.createDataFrame([{k: r.get(k) for k in ("id", "fias_id", "iso", "code", "name", "district")} for r in stored], REGION)
    b = spark.createDataFrame([{k: r.get(k) for k in ("ord", "id", "fias_id", "iso", "code", "name", "district")} for r in batch], f"ord long, {REGION}").repartition(3)
    table, conflicts = identity.upsert_entities(s, b, identity.region_keys(), "ord", fill)
    return sorted(map(tuple, table.collect()), key=str), sorted(map(tuple, conflicts.collect()))


def region(i, fias=None, iso=None, code=None, name=None, district=None, **more):
    return {"id": i, "fias_id": fias, "iso": iso, "code": code, "name": name, "district": district, **more}


def test_a_chain_of_different_keys_is_one_entity(spark):
    stored = [region(7, fias="A", name="old a", district="x"), region(3, iso="RU-C", name="c"), region(9, name="other")]
    batch = [region(100, fias="A", name="c", ord=1), region(101, code="RU-C", name="last", ord=2)]
    table, conflicts = upserted(spark, stored, batch)
    assert table == [(3, None, None, "RU-C", "last", None), (9, None, None, None, "other", None)] and conflicts == [(3, 7)]
    assert upserted(spark, stored, batch, fill=("fias_id",))[0][0][1] == "A"


def test_stored_rows_that_nothing_reaches_stay(spark):
    stored = [region(1, name="same"), region(2, name="same"), region(3, fias="", name="z")]
    assert upserted(spark, stored, [region(50, fias="", name="new", ord=1)])[0] == [(1, None, None, None, "same", None), (2, None, None, None, "same", None), (3, "", None, None, "z", None), (50, "", None, None, "new", None)]
    assert upserted(spark, stored, [])[0] == [(1, None, None, None, "same", None), (2, None, None, None, "same", None), (3, "", None, None, "z", None)]
    assert upserted(spark, [], [region(50, name="a", ord=2), region(49, name="a", district="first", ord=1)]) == ([(49, None, None, None, "a", None)], [])


@pytest.mark.parametrize("seed", range(4))
def test_random_upserts_equal_the_plain_version(spark, seed):
    rng = random.Random(seed)
    pick = lambda n, p: None if rng.random() < p else rng.choice(["", *(f"{x}" for x in range(n))])
    row = lambda i: region(i, pick(30, 0.4), pick(40, 0.6), pick(40, 0.5), f"n{rng.randint(0, 60)}", pick(5, 0.2))
    stored, batch = [row(i) for i in range(25)], [{**row(1000 + i), "ord": i} for i in range(30)]
    assert upserted(spark, stored, batch, fill=("fias_id", "district")) == plain_upsert(stored, batch, ("fias_id", "district"))


def test_key_parts_do_not_run_together(spark):
    rows = spark.createDataFrame([(1, "a", "bc"), (2, "ab", "c"), (3, "", "c"), (4, None, "c")], "r long, x string, y string")
    assert len({r["key"] for r in identity.key_rows(rows, "r", {"k": [F.col("x"), F.col("y")]}).collect()}) == 2


def test_components_of_paths_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (101, 100)] + [(7, 7)]
    got = {r["id"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100}


def plain_merge(place, rows, fields):
    """One contribution after the other, as a person would merge them."""
    place = dict(place)
    for r in rows:
        fine = r["score"] >= (place["score"] or 0)
        for f in fields:
            if r[f] is not None and (fine or place[f] is None):
                place[f] = r[f]
        if place["state"] is None or trust.STATES.index(r["state"]) >= trust.STATES.index(place["state"]):
            place["state"] = r["state"]
        place["is_trusted"] = bool(place["is_trusted"]) or r["is_trusted"]
        place["score"] = max(place["score"] or 0, r["score"])
        place["providers"] = [*place["providers"], *([r["provider"]] if r["provider"] not in place["providers"] else [])]
    return place


FIELDS = ("name", "kind", "lat")
ROW = "place_id long, seq long, provider string, name string, kind string, lat double, score double, is_trusted boolean, state string"


def contributions(rng, n, places=4):
    value = lambda v: None if rng.random() < 0.4 else v
    return [
        {"place_id": rng.randrange(places), "seq": i, "provider": rng.choice(["catalog", "dadata", "llm"]), "name": value(f"n{i}"), "kind": value(rng.choice(["", "city"])), "lat": value(float(i)),
         "score": rng.choice([0.1, 0.5, 0.5, 0.8, 0.9]), "is_trusted": rng.random() < 0.3, "state": rng.choice(trust.STATES)}
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(4))
def test_folding_onto_a_state_equals_folding_everything(spark, seed):
    rng = random.Random(seed)
    rows, cut = contributions(rng, 60), rng.randrange(10, 50)
    frame = lambda r: spark.createDataFrame(r, ROW).repartition(3)
    stored = trust.combine(trust.summary(frame(rows[:cut]), FIELDS, chunk=F.floor(F.col("seq") / 7)), FIELDS)
    merged, missing = trust.fold_onto(stored, frame(rows[cut:]), FIELDS, chunk=F.floor(F.col("seq") / 5))
    got = {r["place_id"]: r.asDict() for r in merged.collect()}
    empty = {**dict.fromkeys(FIELDS), "score": None, "state": None, "is_trusted": None, "providers": []}
    known = {r["place_id"] for r in rows[:cut]}
    assert set(got) == known and {r["place_id"] for r in missing.collect()} == {r["place_id"] for r in rows[cut:]} - known
    whole = {r["place_id"]: r.asDict() for r in trust.fold(frame(rows), FIELDS).collect()}
    for p in known:
        want = plain_merge(empty, [r for r in rows if r["place_id"] == p], FIELDS)
        assert {k: got[p][k] for k in want} == want
        assert {k: whole[p][k] for k in (*FIELDS, "score", "state", "is_trusted", "n")} == {k: got[p][k] for k in (*FIELDS, "score", "state", "is_trusted", "n")}


def test_what_a_batch_changes_is_named(spark):
    stored = spark.createDataFrame([(1, "a", None, None, 0.8, False, "verified", ["catalog"], 1), (2, "b", None, None, None, None, None, None, 0)],
        "place_id long, name string, kind string, lat double, score double, is_trusted boolean, state string, providers array<string>, n long")
    row = lambda p, **x: {"place_id": p, "seq": 1, "provider": "catalog", "name": None, "kind": None, "lat": None, "score": 0.5, "is_trusted": False, "state": "unverified", **x}
    run = lambda *rows: {r["place_id"]: r for r in trust.fold_onto(stored, spark.createDataFrame(list(rows), ROW), FIELDS)[0].collect()}
    got = run(row(1, name="worse", kind="city"), row(2))
    assert (got[1]["name"], got[1]["kind"], got[1]["applied"]) == ("a", "city", "kind,trust_updated_at")
    assert got[2]["applied"] == "trust_state,is_trusted,trust_score,evidence_providers,trust_updated_at" and got[2]["is_trusted"] is False
    assert run(row(1))[1]["applied"] == "" and run(row(3))[2]["name"] == "b"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_versions_are_pinned_and_batches_written_once(spark, tmp_path):
    path, frame = str(tmp_path / "t"), lambda *r: spark.createDataFrame(list(r), "k long, v string, n long")
    assert snapshots.latest(spark, path) == 0
    assert snapshots.put(frame((1, "a", 0), (1, "b", 1), (2, "c", 0)), path, ["k"], [F.desc("n")], batch_id="0") == 1
    assert snapshots.put(frame((1, "x", 5), (3, "d", 0)), path, ["k"], [F.desc("n")], batch_id="1") == 2
    assert snapshots.put(frame((1, "never", 9)), path, ["k"], [F.desc("n")], batch_id="0") == 1
    assert snapshots.append(frame((9, "z", 0)), path) == 3
    assert rows_of(snapshots.read(spark, path, 1)) == [(1, "b", 1), (2, "c", 0)]
    assert rows_of(snapshots.read(spark, path, 2)) == [(1, "x", 5), (2, "c", 0), (3, "d", 0)]
    assert rows_of(snapshots.read(spark, path)) == [(1, "x", 5), (2, "c", 0), (3, "d", 0), (9, "z", 0)]
    with pytest.raises(ValueError, match="no version 7"):
        snapshots.read(spark, path, 7)


def test_a_crash_before_the_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path, frame = str(tmp_path / "t"), lambda v: spark.createDataFrame([(1, v)], "k long, v string")
    snapshots.replace(frame("old"), path)
    pinned, commit = snapshots.read(spark, path), snapshots._commit
    monkeypatch.setattr(snapshots, "_commit", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        snapshots.replace(frame("new"), path, batch_id="7")
    assert rows_of(snapshots.read(spark, path)) == [(1, "old")] and snapshots.latest(spark, path) == 1
    monkeypatch.setattr(snapshots, "_commit", commit)
    assert snapshots.replace(frame("new"), path, batch_id="7") == 2
    assert rows_of(snapshots.read(spark, path)) == [(1, "new")] and rows_of(pinned) == [(1, "old")]


def test_an_empty_batch_and_new_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.append(spark.createDataFrame([(1,)], "k long"), path)
    snapshots.append(spark.createDataFrame([], "k long, v string"), path)
    snapshots.append(spark.createDataFrame([(2, "x")], "k long, v string"), path, rows_per_file=1)
    assert sorted(map(str, map(tuple, snapshots.read(spark, path).collect()))) == ["(1, None)", "(2, 'x')"]


def test_a_stream_that_repeats_a_batch_writes_it_once(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "t")
    spark.range(5).write.parquet(source)
    write = snapshots.batch_writer(path, "q")
    twice = lambda df, i: (write(df, i), write(df, i))
    q = spark.readStream.schema("id long").parquet(source).writeStream.foreachBatch(lambda df, i: twice(df, i) and None).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert snapshots.latest(spark, path) == 1 and snapshots.read(spark, path).count() == 5


def test_deletes_follow_chains_and_rings(spark):
    edge = integrity.Edge
    edges = (edge("place", "parent", "place", on_delete="cascade"), edge("status", "place_id", "place", on_delete="cascade"), edge("cache", "place_id", "place", on_delete="set null"), edge("log", "place_id", "place"), edge("place", "code", "kind", "code"))
    frame = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    tables = {
        "place": frame("id long, parent long, code string", *((i, i - 1 if i else None, "k") for i in range(12)), (50, 51, None), (51, 50, "gone"), (60, 99, "k")),
        "status": frame("id string, place_id long", ("s11", 11), ("s50", 50), ("s60", 60), ("none", None)), "cache": frame("id long, place_id long", (1, 7), (2, 2), (3, 60)),
        "log": frame("id long, place_id long", (1, 8), (2, 3)), "kind": frame("code string", ("k",)),
    }
    got = integrity.delete(tables, {"place": frame("id long", (4,), (51,), (12345,))}, edges).collect()
    assert {(r.tbl, r.row) for r in got if r.effect == "delete"} == {*(("place", str(i)) for i in (*range(4, 12), 50, 51)), ("status", "s11"), ("status", "s50")}
    assert sorted((r.tbl, r.row, r.effect) for r in got if r.effect != "delete") == [("cache", "1", "clear place_id"), ("log", "1", "block place_id")]
    assert sorted(map(tuple, integrity.dangling(tables, edges).collect())) == [("place", "51", "code"), ("place", "60", "parent")]
    assert integrity.delete(tables, {}, edges).count() == 0


def test_the_whole_key_graph_is_checked(spark):
    frame = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    tables = {"regions": frame("id string, geometry_artifact_key string", ("r", None)), "places": frame("id string, region_id string, parent_place_id string, geometry_artifact_key string", ("p", "r", None, "x"), ("q", "lost", "p", None)),
              "place_status": frame("id string, place_id string, status_code string", ("s", "q", "any"), ("t", "nowhere", "any"))}
    assert sorted(map(tuple, integrity.dangling(tables).collect())) == [("place_status", "t", "place_id"), ("places", "q", "region_id")]
    got = integrity.delete(tables, {"regions": tables["regions"]})
    assert sorted(map(tuple, got.collect())) == [("places", "p", "block region_id"), ("regions", "r", "delete")]


def test_no_side_of_an_entity_join_passes_through_the_driver(spark, monkeypatch):
    plans, plan = [], lambda df: df._jdf.queryExecution().executedPlan().toString()
    for module in (graph, identity):
        monkeypatch.setattr(module, "written", lambda df, name, real=module.written: (plans.append(plan(df)), real(df, name))[1])
    names = "id long, fias_id string, iso string, code string, name string, district string"
    stored = snapshots.written(spark.createDataFrame([(7, "A", None, None, "old a", "x"), (3, None, "RU-C", None, "c", "x")], names), "stored")
    batch = snapshots.written(spark.createDataFrame([(1, 100, "A", None, None, "c", "y"), (2, 101, None, None, "RU-C", "last", "y")], f"ord long, {names}"), "batch")
    table, conflicts = identity.upsert_entities(stored, batch, identity.region_keys(), "ord")
    assert [r["id"] for r in table.collect()] == [3] and [tuple(r) for r in conflicts.collect()] == [(3, 7)]
    plans += [plan(table), plan(conflicts)]
    assert sum("SortMergeJoin" in p for p in plans) >= 6 and not any("Broadcast" in p for p in plans)
