"""Settings from a file and the environment, channel manifests, steps that fail, reports of posts without anything."""

import json

import pytest
from pyspark.sql import functions as F

from vigil.operators import answers, geo, merge, reports, resolve
from vigil.sources import config, files, snapshots


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(path)


def test_config_is_the_file_then_the_environment_then_defaults(spark, tmp_path):
    read = lambda path, **env: config.parse_config(spark, path, env)
    none = str(tmp_path / "absent.json")
    assert read(none) == {"batch_limit": 100, "mark_as_read": False, "cursor": None}
    file = put(tmp_path / "a.json", {"batchLimit": 7, "markAsRead": True, "cursor": {"kind": "message_id", "messageId": 5}, "more": 1})
    assert read(file) == {"batch_limit": 7, "mark_as_read": True, "cursor": {"kind": "message_id", "message_id": 5}}
    assert read(file, VIGIL_PARSE_BATCH_LIMIT=" 9 ", VIGIL_PARSE_MARK_AS_READ="no") == {"batch_limit": 9, "mark_as_read": True, "cursor": {"kind": "message_id", "message_id": 5}}
    assert read(none, VIGIL_PARSE_MARK_AS_READ=" YES ")["mark_as_read"]
    assert read(none, VIGIL_PARSE_CONFIG="a.json")["batch_limit"] == read("/nowhere/x.json", VIGIL_PARSE_CONFIG=file)["batch_limit"] == 7
    assert read(put(tmp_path / "list.json", [{"batchLimit": 3}, {"batchLimit": 4}]))["batch_limit"] == 100
    assert read(put(tmp_path / "d.json", {"cursor": {"kind": "date", "dateIso": "2025-05-04T12:00:00Z"}}))["cursor"] == {"kind": "date", "date": "2025-05-04T12:00:00Z"}


@pytest.mark.parametrize("bad", [{"batchLimit": 0}, {"batchLimit": 5001}, {"batchLimit": 1.5}, {"cursor": {"kind": "date"}}, {"cursor": {"kind": "x"}}])
def test_wrong_configs_are_errors(spark, tmp_path, bad):
    with pytest.raises(ValueError, match="batchLimit|cursor"):
        config.parse_config(spark, put(tmp_path / "a.json", bad), {})
    with pytest.raises(ValueError, match="batchLimit"):
        config.parse_config(spark, str(tmp_path / "none"), {"VIGIL_PARSE_BATCH_LIMIT": "many"})


def test_channels_take_their_own_settings_or_the_configs(spark, tmp_path):
    path = put(tmp_path / "m.json", {"version": 1, "channels": [{"key": "a", "telegramTarget": "@a", "parseOverrides": {"batchLimit": 5}}, {"key": "b", "telegramTarget": "b", "enabled": False}, {"key": "c", "telegramTarget": "1", "title": "C", "parseOverrides": {"markAsRead": True}}]})
    rows = config.read_channels(spark, path)
    plan = answers.plan_channels(rows, {"batch_limit": 100, "mark_as_read": False})
    assert sorted((r["key"], r["target"], r["title"], r["batch_limit"], r["mark_as_read"]) for r in plan.collect()) == [("a", "@a", None, 5, False), ("c", "1", "C", 100, True)]
    assert config.read_channels(spark, str(tmp_path / "absent")).count() == 0
    for bad in ({"version": 2, "channels": []}, {"channels": []}, {"version": 1, "channels": [{"key": "", "telegramTarget": "x"}]}, {"version": 1, "channels": [{"key": "k"}]}, {"version": 1, "channels": [{"key": "k", "telegramTarget": "x", "parseOverrides": {"batchLimit": 9999}}]}):
        with pytest.raises(ValueError, match="version|channel"):
            config.read_channels(spark, put(tmp_path / "bad.json", bad))


def test_override_files_may_be_absent(spark, tmp_path):
    assert files.read_override(spark, str(tmp_path / "no.json"), spark.range(0).schema).count() == 0
    assert files.read_override(spark, put(tmp_path / "o.json", [{"id": 4}, {"id": 5}]), spark.range(0).schema).count() == 2


@pytest.mark.parametrize("stored", [None, snapshots.written])
def test_a_failing_step_is_left_out(spark, stored):
    rows, log = spark.range(3).toDF("id"), []
    add = lambda n: lambda df: df.withColumn(n, F.lit(1))
    steps = {"catalog": add("catalog"), "llm": lambda df: df.select("no_such_column"), "dadata": add("dadata"), "nominatim": lambda df: df.withColumn("n", F.raise_error(F.lit("down")))}
    order = geo.STEPS if stored else geo.STEPS[:3]
    out = geo.run_steps(rows, steps, order, add("last"), stored, log)
    assert out.columns == ["id", "catalog", "dadata", "last"] and out.count() == 3
    assert [(x["step"], x["ok"]) for x in log] == [("catalog", True), ("llm", False), ("dadata", True), ("nominatim", False)][: len(order)] and "no_such_column" in log[1]["error"]


def test_precision_of_every_kind_of_place(spark):
    kinds = ["district", "city", "settlement", "locality", "other", None]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(kinds)], "i int, kind string")
    assert [r[0] for r in rows.orderBy("i").select(geo.place_precision(F.col("kind"))).collect()] == ["district", "city", "settlement", "locality", "locality", "locality"]
    posts = spark.createDataFrame([(1,), (2,), (3,), (1,)], "post_id long")
    places = spark.createDataFrame([(1, "district", None, None)], "post_id long, kind string, lat double, lon double")
    regions = spark.createDataFrame([(2,)], "post_id long")
    assert sorted(map(tuple, merge.precision(places, regions, "post_id", posts).collect())) == [(1, "district", 0.5), (2, "region", 0.25), (3, "unknown", 0.0)]


def test_reports_of_posts_without_anything(spark):
    row = "post_id long, raw_text string, hash string, channel_key string, posted_at timestamp, kind string, reason string, event_type string, severity string, repeat boolean, n long, direction string, macro_zone string"
    posts = spark.createDataFrame([(1, "x", "h", "c", None, "noise", "noise_content", None, None, None, None, None, None), (2, "y", "h", "c", None, "event", None, "fixation", "info", True, 3, None, None)], row)
    none = lambda schema: spark.createDataFrame([], schema)
    got = {r["post_id"]: r for r in reports.nested(posts, none("post_id long, code string, name string"), none("post_id long, name string, kind string, region_code string, lat double, lon double"), none("post_id long, provider string, cache_hit boolean")).collect()}
    assert got[1]["event"] is None and got[1]["geo"].asDict() == got[2]["geo"].asDict() == {"regions": [], "places": [], "precision": "unknown", "completeness": 0.0, "source": "local"}
    assert (got[1]["enrich"]["misses"], got[2]["enrich"]["misses"], got[2]["enrich"]["invoked"]) == (0, 1, False) and got[2]["event"]["count"] == 3


def test_messages_have_something_accepted_or_not(spark):
    rows = spark.createDataFrame([(1, "rejected"), (1, "created_new"), (2, "rejected"), (3, "matched"), (3, "matched_existing")], "m long, decision string")
    tallied = resolve.tallies(rows, "m")
    assert sorted(map(tuple, tallied.collect())) == [(1, 0, 1, 1, True), (2, 0, 0, 1, False), (3, 2, 0, 0, True)]
    assert tuple(resolve.message_totals(tallied).first()) == (3, 2, 1, 2, 2, 1) and tuple(resolve.message_totals(tallied.where("false")).first()) == (0, 0, 0, 0, 0, 0)
