"""Answers of outside providers for the places of posts: from the cache, else by one call for each distinct question.

A provider is a function from a list of questions to a list of answers, made once in each task by a factory that the caller
gives (it may open connections; it is never pickled itself). Questions are dealt out so that each is asked once; answers go
into a versioned cache table, from which later runs and later posts of the same question are served.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim
from ..sources import snapshots
from .tables import first_per_key

#: A question: its text as it stands and the region that is hinted at. An answer: place_name, region_code, place_fias, lat, lon.
Answer = dict
Client = Callable[[list[dict]], list[Answer | None]]

ANSWER = "place_name string, region_code string, place_fias string, lat double, lon double"
_ANSWER = pa.struct([("place_name", pa.string()), ("region_code", pa.string()), ("place_fias", pa.string()), ("lat", pa.float64()), ("lon", pa.float64())])
CACHE = f"query_norm string, provider string, {ANSWER}, confidence double, fetched_at long"


def ask(questions: DataFrame, factory: Callable[[], Client], tries: int = 2, batch: int = 100) -> DataFrame:
    """questions (query_norm, raw_text, region_code) with answer (null where there is none) and tries.

    A call that raises is made again, `tries` times in all, and then each question of its batch once by itself, so that one
    bad question costs the others nothing; what fails even so has no answer. tries: calls that a question was part of.
    """
    names = ("query_norm", "raw_text", "region_code")

    def called(client: Client, rows: list[dict], tries: int) -> tuple[list[Answer | None] | None, int]:
        for n in range(1, tries + 1):
            try:
                answers = client(rows)
                if len(answers) == len(rows):
                    return answers, n
            except Exception:  # noqa: BLE001, S112 - whatever a provider raises is a failed call
                continue
        return None, tries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = None
        for b in batches:
            rows, answers, made = b.to_pylist(), [], []
            for at in range(0, len(rows), batch):
                client = client or factory()
                some = rows[at : at + batch]
                got, n = called(client, some, tries)
                made += [n] * len(some)
                if got is None and len(some) > 1:
                    single = [called(client, [r], 1)[0] for r in some]
                    got, made[-len(some) :] = [a[0] if a else None for a in single], [n + 1] * len(some)
                answers += got or [None] * len(some)
            kept = [a and {f.name: a.get(f.name) for f in _ANSWER} for a in answers]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(kept, _ANSWER), pa.array(made, pa.int32())], [*names, "answer", "tries"])

    return questions.select(*names).mapInArrow(run, f"query_norm string, raw_text string, region_code string, answer struct<{ANSWER.replace(' ', ':').replace(',:', ',')}>, tries int")


def query_norm(text: Column) -> Column:
    return trim(F.lower(text))


def provider_step(posts: DataFrame, cache: str, factory: Callable[[], Client], provider: str, at: int, prefix: str = "", fall_back: bool = False, **options: int) -> DataFrame:
    """(post_id, cache_hit, name, kind, region_code, fias_id, lat, lon) of posts that the cache or the provider knows a place for.

    posts: post_id, raw_text, region_code (that of the catalog, else of the language model). cache: the folder of a table that
    holds query_norm, provider, the answer and fetched_at; its latest row for a question counts, whoever gave it. What it
    lacks is asked once, with the text and region of the smallest post_id, and written to it as one batch at the moment `at`;
    a moment's batch is not written twice. Other posts of the question are served as if they came after, from the cache.
    prefix: before the question's text in the cache. fall_back: an answer without a region takes the post's own, also at the
    first post. Posts without a place have no row; an answer without a name takes the question's text.
    """
    spark = posts.sparkSession
    rows = posts.withColumn("_text", query_norm(F.col("raw_text"))).withColumn("query_norm", F.concat(F.lit(prefix), "_text")).where("query_norm is not null")
    known = snapshots.read(spark, cache) if snapshots.latest(spark, cache) else spark.createDataFrame([], CACHE)
    known = first_per_key(known.where(F.col("fetched_at") < at), ["query_norm"], [F.desc("fetched_at"), "provider"])
    missed = rows.join(known.select("query_norm"), "query_norm", "left_anti")
    first = first_per_key(missed.select("query_norm", "raw_text", "region_code", "post_id"), ["query_norm"], ["post_id"])
    asked = snapshots.written(ask(first, factory, **options).where("answer is not null").join(first.select("query_norm", "post_id"), "query_norm"), "answers")
    fresh = asked.select("query_norm", F.lit(provider).alias("provider"), "answer.*", F.lit(None).cast("double").alias("confidence"), F.lit(at).cast("long").alias("fetched_at"))
    snapshots.put(fresh, cache, ["query_norm", "provider"], [F.desc("fetched_at")], batch_id=f"{provider}-{at}")
    answers = known.select("query_norm", F.struct("place_name", "region_code", "place_fias", "lat", "lon").alias("a"), F.lit(None).cast("long").alias("_asker"))
    answers = answers.unionByName(asked.select("query_norm", F.col("answer").alias("a"), F.col("post_id").cast("long").alias("_asker")))
    hit = ~F.col("_asker").eqNullSafe(F.col("post_id"))
    own = F.coalesce("a.region_code", "region_code")
    region = F.when(hit, F.coalesce(own, F.lit(""))).otherwise(own if fall_back else F.col("a.region_code"))
    return rows.join(answers, "query_norm").select(
        "post_id", hit.alias("cache_hit"), F.coalesce("a.place_name", "_text").alias("name"), F.lit("locality").alias("kind"), region.alias("region_code"), F.col("a.place_fias").alias("fias_id"),
        F.col("a.lat").alias("lat"), F.col("a.lon").alias("lon"),
    )
