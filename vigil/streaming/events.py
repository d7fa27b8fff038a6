"""Event logs as Structured Streaming: outbox relay, ingest without duplicates, metrics and activity windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """The outbox: a folder that parquet files are added to; the stream's checkpoint is the mark of what was published."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def relay(events: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, type_column: str = "event_type") -> StreamingQuery:
    """Hand each batch to the handlers of its types, in order, then to those of "*". A batch that failed comes again under
    the same number, so a handler that writes by that number publishes once."""

    def publish(batch: DataFrame, number: int) -> None:
        batch.persist()
        for kind, handle in sorted(handlers.items(), key=lambda x: x[0] == "*"):
            handle(batch if kind == "*" else batch.where(F.col(type_column) == kind), number)
        batch.unpersist()

    return events.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A handler that writes each batch into a folder of its own, so that a repeated batch replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def first_seen(events: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Each message once, by its keys; state older than the delay goes, so it stays bounded."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def activity(events: DataFrame, ts: str = "ts", size: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """Events per window and type; later ones than the delay are dropped by the watermark."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def envelope(type_: Column, aggregate_type: str, aggregate_id: Column, occurred_at: Column, payload: Column) -> list[Column]:
    """The columns of a versioned event; its id follows from what it says, so that the same event has the same id again."""
    kind = F.lit(aggregate_type)
    return [
        F.sha2(F.concat_ws("/", type_, kind, aggregate_id, payload), 256).alias("id"), type_.alias("type"), F.lit(1).alias("version"), occurred_at.alias("occurred_at"),
        kind.alias("aggregate_type"), aggregate_id.alias("aggregate_id"), payload.alias("payload"),
    ]


def parse_events(parsed: DataFrame, key: str, at: str) -> DataFrame:
    """What parsing a message publishes: MessageParseFailed, or what enrichment did and then MessageParsed.

    parsed: key, at, kind, reason, event_type, severity, invoked, cache_hit (booleans), locations (number).
    """
    none = F.lit(None).cast("string")
    event, text = F.col("kind") == "event", lambda c: F.coalesce(F.to_json(c), F.lit("{}"))
    one = lambda when, name, payload: F.when(when, F.struct(F.lit(name).alias("type"), payload.alias("payload")))
    provider = F.lit('{"provider":"unknown"}')
    rows = F.array_compact(
        F.array(
            one(~event, "MessageParseFailed", text(F.struct(F.coalesce("reason", F.lit("not_event")).alias("reason")))),
            one(event & F.col("invoked"), "EnricherInvoked", provider),
            one(event & F.col("cache_hit"), "EnricherCacheHit", provider),
            one(event & (F.coalesce("locations", F.lit(0)) == 0), "EnricherFailed", F.lit('{"reason":"no_location_candidates"}')),
            one(event, "MessageParsed", text(F.struct(F.col("event_type").alias("eventType"), F.coalesce("severity", none).alias("severity")))),
        )
    )
    listed = parsed.select(key, at, F.posexplode(rows).alias("pos", "_e"))
    return listed.select(key, "pos", *envelope(F.col("_e.type"), "raw_message", F.col(key).cast("string"), F.col(at), F.col("_e.payload")))


def ingest_types(messages: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """messages with type: RawMessageIngested for the first of its keys, RawMessageDuplicate for later ones."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    return messages.withColumn("type", F.when(first, "RawMessageIngested").otherwise("RawMessageDuplicate"))


def unpublished(outbox: DataFrame, n: int = 100, at: str = "occurred_at", key: str = "event_id") -> DataFrame:
    """The oldest n events of an outbox that have no mark of publication."""
    return outbox.where(F.col("published_at").isNull()).orderBy(at, key).limit(n)
