"""Streams held against their batch versions: status with expiry, events with locations, states at many moments."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigil.operators import status
from vigil.streaming import status as streams

START = datetime(2024, 1, 1)
HISTORY = "place_id long, status_code string, event_id long, event_at timestamp, action string"


def replay(spark, folder, batches, schema, build, name):
    """Each list of rows as one file and one batch; what the query has given out, and the query's last progress."""
    source = folder / f"{name}-in"
    source.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"{i:03d}"))
        for f in (source / f"{i:03d}").iterdir():
            if f.suffix == ".parquet":
                f.rename(source / f"{i:03d}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", False).option("pathGlobFilter", "*.parquet").parquet(str(source))
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / f"{name}-c")).start()
    q.processAllAvailable()
    progress = q.recentProgress
    q.stop()
    return spark.table(name).collect(), progress


def row(place, minute, action, number=0, code="c"):
    return (place, code, number or minute + 1, START + timedelta(minutes=minute), action)


def random_history(seed, n=60):
    rng = random.Random(seed)
    return [row(rng.randrange(4), 5 * i + rng.randrange(5), rng.choice(["activate", "activate", "deactivate"]), i + 1, rng.choice("ab")) for i in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_changes_equal_the_state_at_every_end(spark, tmp_path, seed):
    rows, ttl = random_history(seed), timedelta(minutes=23)
    batches = [rows[i : i + 15] for i in range(0, 60, 15)] + [[row(99, 10_000, "activate", 9999)], [row(99, 10_001, "deactivate", 10_000)]]
    got, _ = replay(spark, tmp_path, batches, HISTORY, lambda s: streams.status_changes(s, ttl, "10 minutes"), f"changes{seed}")
    log = sorted((r["at"], r["place_id"], r["status_code"], r["change"]) for r in got if r["place_id"] != 99)
    history = spark.createDataFrame(rows, HISTORY)
    for minute in range(0, 330, 13):
        moment = START + timedelta(minutes=minute, seconds=30)
        state = {}
        for at, place, code, change in log:
            if at <= moment:
                state[place, code] = change
        want = {(r["place_id"], r["status_code"]) for r in status.current_until(history, F.lit(moment), "23 MINUTES").collect()}
        assert {k for k, c in state.items() if c == "active"} == want
    assert {c for *_, c in log} == {"active", "inactive", "expired"}


def test_late_and_repeated_rows_change_nothing(spark, tmp_path):
    batches = [[row(1, 10, "activate")], [row(1, 5, "deactivate"), row(1, 10, "activate")], [row(2, 500, "activate")], [row(2, 501, "deactivate")], [row(1, 11, "activate", 77)], [row(3, 900, "activate")], [row(3, 901, "activate")]]
    got, progress = replay(spark, tmp_path, batches, HISTORY, lambda s: streams.status_changes(s, timedelta(minutes=60), "30 minutes"), "late")
    assert [(r["change"], r["at"]) for r in got if r["place_id"] == 1] == [("active", START + timedelta(minutes=10)), ("expired", START + timedelta(minutes=70))]
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 1  # only the key in use is kept


EVENTS, LOCATIONS = "event_id long, event_at timestamp, name string", "event_id long, located_at timestamp, place string"


def test_joined_streams_equal_the_batch(spark, tmp_path):
    rng = random.Random(3)
    at = lambda m: START + timedelta(minutes=m)
    events = [(i, at(4 * i), f"e{i}") for i in range(40)]
    locations = [(i, at(4 * i + d), f"l{d}") for i, d in ((rng.randrange(40), rng.choice([-1, 0, 5, 60, 61])) for _ in range(70))]
    locations = sorted(set(locations), key=lambda r: r[1])
    schema = "side string, " + EVENTS.replace("name", "x") + ", y string"
    mixed = sorted([("e", i, t, x, None) for i, t, x in events] + [("l", i, t, None, y) for i, t, y in locations], key=lambda r: r[2])
    end = [("e", 1000, at(2000), "end", None), ("l", 1001, at(2000), None, "end")]
    batches = [mixed[i : i + 20] for i in range(0, len(mixed), 20)] + [end, [("e", 1002, at(2001), "end", None), ("l", 1003, at(2001), None, "end")]]

    def build(s):
        left = s.where("side = 'e'").select("event_id", "event_at", F.col("x").alias("name"))
        return streams.with_locations(left, s.where("side = 'l'").select("event_id", F.col("event_at").alias("located_at"), F.col("y").alias("place")), "60 MINUTES", "10 minutes")

    got, _ = replay(spark, tmp_path, batches, schema, build, "joined")
    want = streams.with_locations(spark.createDataFrame(events, EVENTS), spark.createDataFrame(locations, LOCATIONS), "60 MINUTES").collect()
    assert sorted(map(str, want)) == sorted(str(r) for r in got if r["event_id"] < 1000)
    assert sum(r["place"] is None for r in want) > 3 and len(want) > 40


@pytest.mark.parametrize("bucket", ["1 minute", "7 minutes", "30 days"])
def test_states_at_many_moments_equal_one_by_one(spark, bucket):
    rows = random_history(5) + [row(1, 50, "activate", 500, "a"), row(1, 50, "deactivate", 501, "a"), row(7, 1, "activate")]
    rng = random.Random(1)
    asked = [(q, rng.choice([0, 1, 2, 3, 7, 8]), rng.choice("abc"), START + timedelta(minutes=rng.randrange(-5, 320))) for q in range(150)] + [(150, 1, "a", START + timedelta(minutes=50))]
    asked.append(asked[0])
    history, questions = spark.createDataFrame(rows, HISTORY), spark.createDataFrame(asked, "q long, place_id long, status_code string, at timestamp")
    got = sorted(map(tuple, status.at_moments(history, questions, bucket=bucket).collect()), key=str)
    want = []
    for q, place, code, moment in asked:
        past = [r for r in rows if r[0] == place and r[1] == code and r[3] <= moment]
        last = max(past, key=lambda r: (r[3], r[2])) if past else None
        active = last is not None and last[4] == "activate"
        want.append((q, place, code, moment, active, last[3] if active else None))
    assert got == sorted(want, key=str)


def test_plain_timestamps():
    assert streams._ms(pd.Timestamp("1970-01-01 00:00:01.5")) == 1500
