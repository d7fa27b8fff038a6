"""Match-or-create with all its effects, against the same done one candidate after the other; provider steps with a client that fails."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vigil.operators import providers, trust, validation
from vigil.sources import snapshots

STORED = "place_id long, region_id string, name string, fias_id string, lat double, lon double, score double, is_trusted boolean, state string, providers array<string>"
CANDIDATE = "seq long, region_id string, name string, fias_id string, lat double, lon double, provider string, confidence double"
NAMES = ("name", "fias_id", "lat", "lon")
APPLIED = ("name", "fias_id", "centroid_lat", "centroid_lon")


def norm(name):
    return re.sub(r"[\W_]+", " ", name.lower().replace("ё", "е")).strip()


def look(name):
    """As aliases are looked up: trimmed before signs become spaces, so that one at an edge leaves a space."""
    return re.sub(r"[\W_]+", " ", name.strip().lower().replace("ё", "е"))


def plain(candidates, stored, aliases, first_new):
    """One after the other."""
    places, known = {p["place_id"]: {**p, "is_trusted": bool(p["is_trusted"])} for p in stored}, [(a, p) for a, p, _ in sorted(aliases, key=lambda x: (x[2], x[1]))]
    decisions, evidence, texts = [], [], {}
    for c in sorted(candidates, key=lambda c: c["seq"]):
        if c["region_id"] is None or not c["name"]:
            decisions.append((c["seq"], "rejected", None))
            continue
        score = c["confidence"] if c["confidence"] is not None else trust.PROVIDER_SCORE[c["provider"]]
        trusted = c["provider"] in trust.TRUSTED or score >= 0.9
        state = "verified" if trusted else "partially_verified" if score >= 0.7 else "unverified"
        hit = min((i for i, p in places.items() if c["fias_id"] and p["fias_id"] == c["fias_id"]), default=None)
        if hit is None:
            hit = next((p for a, p in known if a == look(c["name"])), None)
        if hit is None:
            hit = min((i for i, p in places.items() if p["region_id"] == c["region_id"] and norm(p["name"]) == norm(c["name"])), default=None)
        if hit is None:
            hit = first_new + c["seq"]
            places[hit] = {"place_id": hit, **{k: c[k] for k in ("region_id", *NAMES)}, "score": score, "is_trusted": trusted, "state": state, "providers": [c["provider"]]}
            decisions.append((c["seq"], "created_new", hit))
            evidence.append((c["seq"], hit, c["provider"], "candidate", ""))
        else:
            p, applied = places[hit], []
            fine = score >= (p["score"] or 0)
            for f, n in zip(NAMES, APPLIED, strict=True):
                if c[f] is not None and (fine or p[f] is None) and p[f] != c[f]:
                    p[f] = c[f]
                    applied.append(n)
            if p["state"] is None or trust.STATES.index(state) > trust.STATES.index(p["state"]):
                p["state"] = state
                applied.append("trust_state")
            if trusted and not p["is_trusted"]:
                p["is_trusted"] = True
                applied.append("is_trusted")
            if score > (p["score"] or 0):
                p["score"] = score
                applied.append("trust_score")
            if c["provider"] not in p["providers"]:
                p["providers"] = [*p["providers"], c["provider"]]
                applied.append("evidence_providers")
            decisions.append((c["seq"], "matched_existing", hit))
            evidence.append((c["seq"], hit, c["provider"], "enrich" if applied else "confirm", ",".join([*applied, "trust_updated_at"] if applied else [])))
        known.append((look(c["name"]), hit))
        texts[hit, look(c["name"])] = c["name"]
    return decisions, evidence, sorted((p, a, t) for (p, a), t in texts.items()), places


def run(spark, candidates, stored, aliases, first_new=1000):
    frame = lambda rows, schema: spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in schema.split(", ")) for r in rows], schema)
    out = validation.validate(frame(candidates, CANDIDATE).repartition(3), frame(stored, STORED), spark.createDataFrame([(p, a, o) for a, p, o in aliases], "place_id long, alias_norm string, ord long"), first_new)
    return {k: v.collect() for k, v in out.items()}


def same(spark, candidates, stored, aliases):
    got = run(spark, candidates, stored, aliases)
    decisions, evidence, texts, places = plain(candidates, stored, aliases, 1000)
    assert sorted(map(tuple, got["decisions"])) == decisions
    assert sorted(map(tuple, got["evidence"])) == evidence
    assert sorted(map(tuple, got["aliases"])) == texts
    assert {r["place_id"]: r.asDict() for r in got["places"]} == {i: {k: p[k] for k in ("place_id", "region_id", *NAMES, "score", "is_trusted", "state", "providers")} for i, p in places.items()}


def candidate(seq, region, name, fias=None, provider="llm", confidence=None, lat=None, lon=None):
    return {"seq": seq, "region_id": region, "name": name, "fias_id": fias, "lat": lat, "lon": lon, "provider": provider, "confidence": confidence}


def place(i, region, name, fias=None, score=None, trusted=None, state=None, names=()):
    return {"place_id": i, "region_id": region, "name": name, "fias_id": fias, "lat": None, "lon": None, "score": score, "is_trusted": trusted, "state": state, "providers": list(names)}


def test_an_id_given_by_one_candidate_is_found_by_the_next(spark):
    """A low score gives the id and is remembered as an alias; the next finds the place by the id alone and renames it."""
    stored = [place(1, "31", "Старое место", score=0.95, trusted=True, state="verified", names=["catalog"])]
    rows = [candidate(1, "31", "Старое место", "fias-1", confidence=0.55), candidate(2, "31", "Новое место", "fias-1", "dadata", 0.99, 51.1, 37.6), candidate(3, "99", "старое-место"), candidate(4, "31", "новое  место", None, "nominatim")]
    same(spark, rows, stored, [])
    got = run(spark, rows, stored, [])
    assert {r["place_id"] for r in got["decisions"]} == {1} and len(got["places"]) == 1
    assert [r["action"] for r in sorted(got["evidence"])] == ["enrich", "enrich", "confirm", "enrich"]


def test_what_is_created_is_matched_later(spark):
    rows = [candidate(1, "a", "New Town", "f"), candidate(2, None, "New Town"), candidate(3, "b", "New-Town"), candidate(4, "b", "Other", "f"), candidate(5, "a", "other"), candidate(6, "a", ""), candidate(7, "b", "Third", "g"), candidate(8, "b", "third", "f")]
    same(spark, rows, [], [])
    assert run(spark, [], [], []) == {"decisions": [], "evidence": [], "aliases": [], "places": []}


@pytest.mark.parametrize("seed", range(3))
def test_random_candidates_equal_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    town = lambda: rng.choice(["Alpha", "beta-", "GAMMA", "delta x", "Ёж", "еж", "zeta"])
    maybe = lambda v, p: v if rng.random() < p else None
    stored = [place(i, rng.choice("ab"), f"{town()}", maybe(f"f{rng.randrange(6)}", 0.5), maybe(rng.choice([0.2, 0.6, 0.9]), 0.8), maybe(rng.random() < 0.3, 0.7), maybe(rng.choice(trust.STATES), 0.7), ["catalog"] * (i % 2)) for i in range(6)]
    aliases = [(norm(town()), rng.randrange(6), i) for i in range(2)]
    rows = [candidate(s, maybe(rng.choice("ab"), 0.95), maybe(town() + rng.choice(["", " 1", " 2"]), 0.95), maybe(f"f{rng.randrange(8)}", 0.5), rng.choice(["llm", "dadata", "nominatim"]), maybe(rng.choice([0.1, 0.5, 0.8, 0.95]), 0.6), maybe(float(s), 0.4), maybe(1.0, 0.4)) for s in rng.sample(range(500), 40)]
    same(spark, rows, stored, aliases)


def test_rounds_do_not_follow_the_candidates_of_an_id(spark, monkeypatch):
    """Each claim of an id that another place took away is settled with all later candidates of that id, not one a round."""
    rounds, store = [], validation.written
    monkeypatch.setattr(validation, "written", lambda df, name: rounds.append(name) or store(df, name))
    rng = random.Random(5)
    stored = [place(i, "ab"[i % 2], f"Town {i}", f"f{i}" if i % 3 else None, i / 20, i % 2 == 0, "unverified", ["catalog"] if i % 2 else []) for i in range(10)]
    rows = [candidate(s, rng.choice("ab"), f"Town {rng.randrange(14)}", f"f{rng.randrange(12)}" if s % 3 else None, rng.choice(["llm", "dadata", "nominatim"]), rng.random()) for s in range(240)]
    same(spark, rows, stored, [("town 11", 3, 0)])
    assert rounds.count("placed") <= 10


def test_an_id_is_free_again_once_its_place_has_another(spark):
    """Also where two stored places have it, where it is given away to the empty text, and where a claim is too weak to be taken."""
    stored = [place(1, "a", "One", "f", 0.9), place(2, "a", "Two", "f", 0.1), place(3, "a", "Three", None, 0.9, names=["llm"])]
    rows = [candidate(1, "a", "One", "f", confidence=0.1), candidate(2, "a", "Two", "g", confidence=0.5), candidate(3, "a", "Two", "f", confidence=0.2), candidate(4, "a", "One", "", "dadata", 0.95)]
    rows += [candidate(5, "a", "Two", "f", confidence=0.1), candidate(6, "a", "Three", "f", confidence=0.1), candidate(7, "a", "Two", "f", "llm", 0.99), candidate(8, "b", "Four", "f"), candidate(9, "b", "Four", "h"), candidate(10, "a", "Four", "f")]
    same(spark, rows, stored, [])


def test_providers_are_listed_in_order_of_their_first_rows(spark):
    stored = [place(1, "a", "One", names=["x", "llm"]), {**place(2, "a", "Two"), "providers": None}]
    rows = [candidate(s, "a", n, None, p) for s, (n, p) in enumerate([("One", "nominatim"), ("One", "llm"), ("Two", "dadata"), ("One", "x"), ("Two", "llm"), ("Two", "dadata"), ("New", "llm")])]
    got = run(spark, rows, stored, [])
    assert {r["place_id"]: r["providers"] for r in got["places"]} == {1: ["x", "llm", "nominatim"], 2: ["dadata", "llm"], 1006: ["llm"]}
    assert [r["applied"] != "" and "evidence_providers" in r["applied"] for r in sorted(got["evidence"])] == [True, False, True, False, True, False, False]


def test_no_list_of_all_rows_of_a_place(spark):
    """Lists are of distinct providers; nothing gathers a place's candidates."""
    frame = lambda rows, schema: spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in schema.split(", ")) for r in rows], schema)
    places = validation.validate(frame([candidate(1, "a", "One")], CANDIDATE), frame([], STORED), spark.createDataFrame([], "place_id long, alias_norm string, ord long"), 1000)["places"]
    plan = places._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(struct(_o") == plan.count("collect_list(") > 0


def counting(path, answer):
    """A client that notes each question it is asked in a file of its own."""

    def factory():
        def client(rows):
            for r in rows:
                with open(path, "a") as f:  # noqa: PTH123
                    f.write(r["query_norm"] + "\n")
            return [answer(r) for r in rows]

        return client

    return factory


POST = "post_id long, raw_text string, region_code string"


def test_each_question_is_asked_once_and_then_cached(spark, tmp_path):
    posts = spark.createDataFrame([(1, " Town ", "40"), (2, "TOWN", "57"), (3, "nowhere", None), (4, None, "1"), (5, "bare", None)], POST)
    cache, calls = str(tmp_path / "cache"), tmp_path / "calls"
    give = lambda r: None if "nowhere" in r["raw_text"] else {"place_name": "Town" if "own" in r["raw_text"] else None, "region_code": None, "lat": 1.5}
    step = lambda at, **k: sorted(tuple(r)[:5] for r in providers.provider_step(posts, cache, counting(calls, give), "dadata", at, **k).collect())
    assert step(10) == [(1, False, "Town", "locality", None), (2, True, "Town", "locality", "57"), (5, False, "bare", "locality", None)]
    assert sorted(calls.read_text().split()) == ["bare", "nowhere", "town"]
    assert step(11) == [(1, True, "Town", "locality", "40"), (2, True, "Town", "locality", "57"), (5, True, "bare", "locality", "")]
    assert sorted(calls.read_text().split()) == ["bare", "nowhere", "nowhere", "town"]
    assert step(12, prefix="nominatim:", fall_back=True)[0] == (1, False, "Town", "locality", "40")
    assert {r["query_norm"] for r in snapshots.read(spark, cache).collect()} == {"town", "bare", "nominatim:town", "nominatim:bare"}


def test_a_failing_question_costs_the_others_nothing(spark, tmp_path):
    def factory():
        def client(rows):
            if any("bad" in r["raw_text"] for r in rows):
                raise ConnectionError
            return [{"place_name": r["raw_text"]} for r in rows]

        return client

    rows = spark.createDataFrame([(f"q{i}", "bad" if i == 3 else f"t{i}", None) for i in range(7)], "query_norm string, raw_text string, region_code string").coalesce(1)
    got = {r["query_norm"]: (r["answer"] and r["answer"]["place_name"], r["tries"]) for r in providers.ask(rows, factory, tries=3, batch=4).collect()}
    assert got == {"q0": ("t0", 4), "q1": ("t1", 4), "q2": ("t2", 4), "q3": (None, 4), "q4": ("t4", 1), "q5": ("t5", 1), "q6": ("t6", 1)}
    assert providers.ask(rows.where("false"), factory).count() == 0
