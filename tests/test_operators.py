"""Folds, matching, files and streams on small inputs with known answers."""

import datetime as dt
import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions import rules, text
from vigil.operators import gazetteer, geo, merge, tables, trust
from vigil.plans import QUERIES, alerts, posts
from vigil.sources import files
from vigil.streaming import events as streams

SF = "/root/testdata/sf0.001"
SEQ = "place_id long, seq long, provider string, confidence double, name string"


def scored(spark, rows):
    df = spark.createDataFrame(rows, SEQ).withColumn("score", trust.score_of(F.col("provider"), F.col("confidence")))
    df = df.withColumn("is_trusted", trust.is_trusted(F.col("provider"), F.col("score")))
    return df.withColumn("state", trust.state_of(F.col("is_trusted"), F.col("score")))


def test_fold_keeps_trust_and_lets_higher_scores_overwrite(spark):
    r = trust.fold(scored(spark, [(1, 1, "llm", 0.5, "low"), (1, 2, "catalog", 1.0, "high"), (1, 3, "llm", 0.6, "later")]), ("name",)).first()
    assert (r["name"], r["score"], r["is_trusted"], r["state"]) == ("high", 1.0, True, "verified")


def test_fold_backfills_empty_fields_from_lower_scores(spark):
    r = trust.fold(scored(spark, [(1, 1, "catalog", 1.0, None), (1, 2, "llm", 0.3, "filled")]), ("name",)).first()
    assert r["name"] == "filled" and r["score"] == 1.0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["catalog", "dadata", "nominatim", "llm"]), st.none() | st.integers(0, 10), st.none() | st.sampled_from("ab")), min_size=1, max_size=6))
def test_fold_equals_one_contribution_after_the_other(spark, rows):
    rows = [(1, i, p, None if c is None else c / 10, n) for i, (p, c, n) in enumerate(rows)]
    want, best = None, 0.0
    for r in scored(spark, rows).orderBy("seq").collect():
        if r["name"] is not None and (r["score"] >= best or want is None):
            want = r["name"]
        best = max(best, r["score"])
    got = trust.fold(scored(spark, rows), ("name",)).first()
    assert (got["name"], got["score"]) == (want, best)


def test_upsert_takes_the_last_update_and_keeps_others(spark):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, name string, seq long")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id long, name string, seq long")
    assert sorted(tuple(r) for r in tables.upsert(base, new, ["id"], [F.desc("seq")]).select("id", "name").collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_files_are_read_and_written(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.txt").write_text("two\n\nblocks")
    (tmp_path / "in" / "A.TXT").write_text("")
    (tmp_path / "in" / "c.md").write_text("no")
    assert {r["file"] for r in files.read_exports(spark, str(tmp_path / "in")).collect()} >= {"b.txt"}
    head = "name,type,name_with_type,federal_district,kladr_id,fias_id,okato,oktmo,tax_office,postal_code,iso_code"
    (tmp_path / "r.csv").write_text(f"{head}\nОдин,Респ,,Южный,0100000000000,f1,,,,,RU-AA\nДва,край,Два край,,,,,,,,RU-BB\nТри,обл,Три обл,,,,,,,,\n")
    rows = {r["code"]: (r["full_name"], r["fias_id"]) for r in files.read_regions(spark, str(tmp_path / "r.csv")).collect()}
    assert rows == {"01": ("Респ Один", "f1"), "BB": ("Два край", None)}
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "Town_x.geojson").write_text(json.dumps({"features": [{"geometry": {"coordinates": [[[36.5, -54.25], [1, 2]]]}}]}))
    assert [tuple(r) for r in files.read_cities(spark, str(tmp_path / "g")).collect()] == [("Town", 36.5, -54.25)]
    schema = T.StructType.fromDDL("code string")
    assert files.read_override(spark, str(tmp_path / "none.json"), schema).count() == 0
    hashes = files.artifact_hashes(spark, str(tmp_path / "g"))
    manifest = hashes.select("key", "sha256").union(spark.createDataFrame([("gone", "x")], "key string, sha256 string"))
    assert tuple(files.verify_artifacts(hashes, manifest).first()) == (2, 1, 0)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 3, "view" if i % 2 else "click", dt.datetime(2024, 1, 1 + i % 4, i % 24)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = streams.event_stream(spark, str(tmp_path / "in"), df.schema)
    out = str(tmp_path / "out")
    streams.relay(stream, {"view": streams.append_by_batch(f"{out}/view"), "*": streams.append_by_batch(f"{out}/all")}, str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(f"{out}/all").count() == 40 and spark.read.parquet(f"{out}/view").count() == 20
    once = streams.first_seen(stream.drop("event_id"), ["user_id", "event_type"], delay="30 days")
    once.writeStream.format("parquet").option("path", f"{out}/once").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{out}/once").count() == 6
    query = streams.activity(stream, delay="30 days").writeStream.format("memory").queryName("activity_now").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = df.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").count().select("w.start", "event_type", "count")
    assert sorted(map(tuple, spark.table("activity_now").collect())) == sorted(map(tuple, batch.collect()))


DISTRICTS = "бпла|угроза|опасность|внимание|фиксация|отбой"
LETTER = "[а-яёА-ЯЁa-zA-Z]"


def plain_districts(text):
    """Left to right: one to forty letters, hyphens or spaces, as few as will do, before " район" as a word of its own."""
    found, at = [], 0
    word = lambda c: c.isalnum() or c == "_"
    while at < len(text):
        if re.match(LETTER, text[at]) and (at == 0 or not word(text[at - 1])):
            for n in range(1, 41):
                body, end = text[at + 1 : at + 1 + n], at + 1 + n
                if len(body) < n or not re.fullmatch(r"[а-яёА-ЯЁa-zA-Z\-\s]+", body):
                    n = 41
                    break
                tail = text[end : end + 6]
                if len(tail) == 6 and tail[0].isspace() and tail[1:].lower() == "район" and (end + 6 == len(text) or not word(text[end + 6])):
                    name = re.sub(rf"^(?:{DISTRICTS})\s+(?:по\s+|на\s+)?", "", text[at : end + 6].strip(), flags=re.I)
                    name = re.sub(r"^(?:по|на|в|во|к|из|от)\s+", "", name, flags=re.I).strip()
                    found.append(name)
                    at = end + 6
                    break
            else:
                n = 41
            if n <= 40:
                continue
        at += 1
    return [x for x in found if x]


def plain_cities(text):
    tidy = lambda names: [y for x in names if re.search("[А-ЯЁ][а-яё-]{2,}", y := re.sub("[.?!;:]", "", x).strip())]
    airport = re.findall(r"аэропорт\s+([А-ЯЁ][а-яё-]{2,})", text, flags=re.I)
    prefixed = re.findall(r"(?:^|[\s,;])(?:г\.|город)\s*([А-ЯЁ][а-яё-]{2,})", text, flags=re.I | re.M)
    noise = "область|край|республика|ао|район|бпла|пво|опасност|внимани|фиксац|отбой|ограничения|ивп|работа|сбит|угроза|меры|подписаться|обход|радар|@"
    lines = [x.strip() for x in text.replace("\r", "").split("\n")]
    plain = [y for x in lines if x and not re.search(noise, x, flags=re.I) for y in x.split(",")]
    return list(dict.fromkeys([*tidy(airport), *tidy(prefixed), *tidy(plain)]))


def posts_of(spark):
    return [(r["post_id"], r["raw_text"]) for r in posts.posts(spark, SF).collect()] + [
        (-1, "Внимание по Сухиничский район, Жиздринский  район; на Думиничский район"), (-2, "район"), (-3, "Калуга, Тула\nг. Орёл и город Брянск\nаэропорт Псков закрыт"),
        (-4, "ЛИПЕЦК\nЛипецк?, Ли\nОбход: Тверь"), (-5, "Очень " * 12 + "район"), (-6, "xрайон Энский районный, Энский район."), (-7, "Тула!!\r\nТула"),
    ]


def test_districts_and_fallback_cities_equal_plain_versions(spark):
    rows = posts_of(spark)
    df = spark.createDataFrame(rows, "post_id long, raw_text string")
    got = {r[0]: (r[1], r[2]) for r in df.select("post_id", gazetteer.district_array(F.col("raw_text")), gazetteer.fallback_city_array(F.col("raw_text"))).collect()}
    assert {i: (plain_districts(t), plain_cities(t)) for i, t in rows} == got
    assert any(a for a, _ in got.values()) and any(b for _, b in got.values())


def test_catalog_step_equals_plain_version(spark):
    rows = posts_of(spark)
    df = spark.createDataFrame(rows, "post_id long, raw_text string")
    cities, regions = alerts._cities(spark), posts.regions(spark)
    first = {r["post_id"]: r["code"] for r in gazetteer.match_regions(df, "post_id", "raw_text", regions).where("rank = 1").collect()}
    known = {}
    for r in gazetteer.match_cities(df, "post_id", "raw_text", cities).orderBy("rank").collect():
        known.setdefault(r["post_id"], []).append((r["name"], r["lat"], r["lon"]))
    want = set()
    for i, t in rows:
        every = [("district", x, None, None) for x in plain_districts(t)] + [("city", *x) for x in known.get(i, [])] + [("city", x, None, None) for x in plain_cities(t)]
        last = {}
        for kind, name, lat, lon in every:
            last[kind, re.sub(r"\s+", " ", re.sub("[\"'`]", "", name.lower().replace("ё", "е"))).strip()] = (kind, name, lat, lon)
        want |= {(i, *x, first.get(i)) for x in last.values() if i in first or x[0] == "city"}
    got = geo.catalog_places(df, "post_id", "raw_text", regions, cities).collect()
    assert {(r["post_id"], r["kind"], r["name"], r["lat"], r["lon"], r["region_code"]) for r in got} == want and len(got) == len(want)


def test_aliases_of_any_length_are_found(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "вчера в очень длинное название из семи слов тут было тихо"), (2, "из семи слов")], "post_id long, t string")
    names = spark.createDataFrame([("a", "A", 0, "очень длинное название из семи слов тут"), ("b", "B", 1, "слов")], "code string, name string, ord int, alias string")
    want = [(1, "a", 2, 1), (1, "b", 7, 2), (2, "b", 2, 1)]
    for most in (gazetteer.LITERALS, 0):
        monkeypatch.setattr(gazetteer, "LITERALS", most)
        got = gazetteer.match_names(texts, "post_id", F.col("t"), names)
        assert sorted((r["post_id"], r["code"], r["position"], r["rank"]) for r in got.collect()) == want
    assert gazetteer.match_names(texts, "post_id", F.col("t"), names.where("false")).count() == 0


def test_manifest_and_artifacts_of_two_folders(spark, tmp_path):
    for folder, text in (("a", "one"), ("b", "two")):
        (tmp_path / "f" / folder).mkdir(parents=True)
        (tmp_path / "f" / folder / "same.csv").write_text(text)
    hashes = files.artifact_hashes(spark, str(tmp_path / "f"))
    assert {r["key"]: r["bytes"] for r in hashes.collect()} == {"a/same.csv": 3, "b/same.csv": 3}
    sha = {r["key"]: r["sha256"] for r in hashes.collect()}
    listed = [{"artifactKey": k, "sha256": h, "byteSize": 3, "sourceId": k[0]} for k, h in [*sha.items(), ("c/gone.csv", "x")]]
    (tmp_path / "manifest.json").write_text(json.dumps({"version": 1, "files": listed}))
    manifest = files.read_manifest(spark, str(tmp_path / "manifest.json"))
    assert tuple(files.verify_artifacts(hashes, manifest).first()) == (3, 1, 0)
    assert [r["revision"] for r in files.listed(manifest, "a", "a/").collect()] == ["unknown"]
    assert files.read_manifest(spark, str(tmp_path / "none.json")).count() == 0


def test_bounding_boxes_are_no_places(spark, tmp_path):
    (tmp_path / "g").mkdir()
    feature = {"type": "Feature", "bbox": [1.5, 2.5, 3.5, 4.5], "geometry": {"type": "Polygon", "bbox": [9, 8, 7, 6], "coordinates": [[[36.5, 54.5], [37, 55]]]}}
    (tmp_path / "g" / "Town_x.geojson").write_text(json.dumps({"bbox": [1, 2, 3, 4], "features": [feature]}))
    assert tuple(files.read_cities(spark, str(tmp_path / "g")).first()) == ("Town", 36.5, 54.5)


def test_steps_counts_and_sinks(spark, tmp_path):
    assert geo.step_order("llm, none,Catalog") == ("llm", "catalog") and geo.step_order(" ") == geo.STEPS
    add = lambda name: lambda df: df.withColumn("log", F.concat("log", F.lit(name)))
    rows = spark.createDataFrame([(1, "")], "post_id long, log string")
    assert geo.run_steps(rows, {"llm": add("l"), "catalog": add("c")}, ("catalog", "dadata", "llm"), add("!")).first()["log"] == "cl!"
    got = spark.range(1).select(merge.enrich_counts(F.array(), F.lit(0), F.lit(None).cast("boolean")).alias("a"), merge.enrich_counts(F.array(F.lit("llm")), F.lit(2), F.lit(True)).alias("b")).first()
    assert tuple(got["a"]) == (False, 0, 1, False) and tuple(got["b"]) == (True, 2, 0, True)
    none = spark.createDataFrame([], "post_id long, kind string, lat double, lon double")
    assert [tuple(r) for r in merge.precision(none, none, "post_id", rows).collect()] == [(1, "unknown", 0.0)]
    report = spark.createDataFrame([(1, "event", 'a "b", c', "", "", 2, "40", "region", "local")], ", ".join(f"`{c}` {'int' if c in ('index', 'count') else 'string'}" for c in files.REPORT_COLUMNS))
    for _ in range(2):  # what was there before goes
        files.write_csv(report, str(tmp_path / "csv"))
        files.write_json(report, str(tmp_path / "json"), by=("kind",))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).collect()[0]["reason"] == 'a "b", c'
    assert spark.read.json(str(tmp_path / "json")).count() == 1 and (tmp_path / "json" / "kind=event").exists()


def test_a_filter_on_classified_posts_computes_the_body_once(spark):
    """The footer pattern stands once in the optimized plan, however often the result's columns are asked for."""
    posts = spark.createDataFrame([(1, "Фиксация БПЛА\n🌐 Обход блокировок")], "post_id long, raw_text string")
    found = rules.classify(posts, "raw_text").where("kind = 'event' and event_type <> 'x' and severity <> 'y'")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Обход") == 1
    assert [r["event_type"] for r in found.collect()] == ["fixation"]


def test_names_are_found_inside_the_row_and_by_join(spark, monkeypatch):
    aliases = spark.createDataFrame([("a", "A", 1, "red fox"), ("b", "B", 2, "fox"), ("c", "C", 3, "a very long name of six"), ("d", "D", 4, "red fox")], "code string, name string, ord int, alias string")
    posts = spark.createDataFrame([(1, "the red fox and a very long name of six fox"), (2, ""), (3, "red"), (4, "fox red fox")], "k long, t string")
    run = lambda: sorted(map(tuple, gazetteer.match_names(posts, "k", F.col("t"), aliases).collect()))
    inside = run()
    monkeypatch.setattr(gazetteer, "LITERALS", 1)
    assert run() == inside
    assert [(r[0], r[1], r[3], r[6]) for r in inside] == [(1, "a", 1, 1), (1, "b", 2, 3), (1, "c", 4, 4), (1, "d", 1, 2), (4, "a", 1, 2), (4, "b", 0, 1), (4, "d", 1, 3)]
    assert gazetteer.match_names(posts, "k", F.col("t"), aliases.where("false")).count() == 0


def test_posts_are_dealt_out_before_their_texts_are_worked_on(spark, sf_dir):
    one_group = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert one_group.rdd.getNumPartitions() == 1 and posts.posts(spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["flat_report", "gap_rows", "nested_reports"])
def test_reports_meet_their_posts_without_driver_or_second_shuffle(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    joins = [line for line in plan.splitlines() if "Join [" in line]
    assert joins and all("SortMergeJoin" in line for line in joins if "post_id" in line or "event_id" in line)
    # what is shuffled are events by their id, before texts are made of them
    assert "hashpartitioning(event_id" in plan


def test_normal_forms_of_one_pass_equal_those_of_single_steps(spark):
    r = random.Random(5)
    signs = list("аЁёZ9 \t\r\n  ﻿\"'`()[]{}«»–,;:.!?_-/^|") + [" "] * 6
    rows = spark.createDataFrame([("".join(r.choice(signs) for _ in range(r.randrange(40))),) for _ in range(3000)] + [(None,)], "t string")
    step = lambda c, pattern, to=" ": text.trim(text.squeeze(F.regexp_replace(c, pattern, to)))
    low = F.replace(F.lower("t"), F.lit("ё"), F.lit("е"))
    region, city = step(F.regexp_replace(low, "[\"'`]", ""), "[()]"), step(F.regexp_replace(low, "[\"'`]", ""), "[_-]+")
    want = {text.norm_region: region, text.region_haystack: step(region, "[,;:.!?()\\[\\]{}«»\"'–—−]"), text.norm_city: city, text.city_haystack: step(city, r"[,;:.!?()\[\]]"), text.norm_place: step(low, "[\"'`]", ""), text.norm_merge: text.trim(text.squeeze(low)), text.norm_geo: text.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))}
    for make, plain in want.items():
        assert rows.where(~make(F.col("t")).eqNullSafe(plain)).count() == 0, make.__name__
