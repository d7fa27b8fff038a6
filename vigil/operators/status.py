"""State of places from the log of activations and deactivations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(history: DataFrame, at: Column | None = None, key: tuple[str, ...] = ("place_id", "status_code")) -> DataFrame:
    """Active statuses at a moment (or now): keys whose latest row up to then activates. The largest row per key combines before the shuffle."""
    rows = history if at is None else history.where(F.col("event_at") <= at)
    latest = rows.groupBy(*key).agg(F.max(F.struct("event_at", "event_id", "action")).alias("l"))
    return latest.where("l.action = 'activate'").select(*key, F.col("l.event_at").alias("since"))


def current_until(history: DataFrame, at: Column, ttl: str, key: tuple[str, ...] = ("place_id", "status_code")) -> DataFrame:
    """as_of, where an activation also ends by itself once the interval ttl is over."""
    return as_of(history, at, key).where(F.col("since") + F.expr(f"INTERVAL {ttl}") > at)


def at_moments(history: DataFrame, questions: DataFrame, key: tuple[str, ...] = ("place_id", "status_code"), bucket: str = "1 day") -> DataFrame:
    """questions (key, at and what else they have) with is_active and since: each key's state at many moments.

    History and questions become one log; the last row before a question is found by a window over its key and bucket of time,
    and where the bucket has none, by a second window over the buckets' last rows. So a key that has most of the log is shared
    out by buckets, and nothing is joined by range. A row of the very moment counts; of rows of one moment the largest event_id.
    """
    others = [c for c in questions.columns if c not in key]
    slot = F.window("_t", bucket)["start"]
    entry = F.struct("event_at", "event_id", "action")
    log = history.select(*key, F.col("event_at").alias("_t"), F.lit(0).alias("_k"), "event_id", entry.alias("_e"), *(F.lit(None).cast(questions.schema[c].dataType).alias(c) for c in others))
    asked = questions.select(*key, F.col("at").alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast(history.schema["event_id"].dataType).alias("event_id"), F.lit(None).cast(log.schema["_e"].dataType).alias("_e"), *others)
    rows = log.unionByName(asked).withColumn("_b", slot)
    near = Window.partitionBy(*key, "_b").orderBy("_t", "_k", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_e", F.last("_e", ignorenulls=True).over(near)).where("_k = 1")
    ends = log.withColumn("_b", slot).groupBy(*key, "_b").agg(F.max("_e").alias("_e"))
    open_slots = asked.withColumn("_b", slot).select(*key, "_b").distinct().withColumn("_e", F.lit(None).cast(log.schema["_e"].dataType))
    both = ends.unionByName(open_slots).groupBy(*key, "_b").agg(F.max("_e").alias("_e"))  # one row per bucket that has rows or questions
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    earlier = both.withColumn("_p", F.last("_e", ignorenulls=True).over(before)).select(*key, "_b", "_p")
    state = F.coalesce("_e", "_p")
    out = found.join(earlier, [*key, "_b"], "left").withColumn("_l", state)
    active = F.coalesce(F.col("_l.action") == "activate", F.lit(False))
    return out.select(*questions.columns, active.alias("is_active"), F.when(active, F.col("_l.event_at")).alias("since"))
