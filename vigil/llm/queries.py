"""The registered queries of this subpackage: each applies one operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, chat, decontaminate, html_text, jaccard, phrases, quality, ring, simhash, substrings, toxicity, warc
from .store import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.search_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    line = F.transform("matches", lambda m: F.concat_ws(":", F.coalesce(m["item_id"], F.lit("")), m["doc_at"].cast("string"), m["item_at"].cast("string"), m["words"].cast("string")))
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["words"])), F.lit(0)).cast("long")
    return out.select(*out.drop("matches").columns, F.size("matches").cast("long").alias("n_matches"), longest.alias("longest_match"), F.sha2(F.array_join(F.array_sort(line), ","), 256).alias("matches_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op5_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(_table(spark, sf_dir, "documents"), bpe.load_ranks(public_tokenizers.path(vocabulary)), public_tokenizers.PATTERN)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql("SELECT -1L AS conv_id, stack(2, 0L, 'user', 1L, 'assistant') AS (turn, role), '</s>[INST] ok [/INST]' AS text")
    messages = written(chat.linear_messages(table.unionByName(planted)), "turns")
    out = written(chat.formatted(chat.chosen_paths(messages), messages), "formatted")
    read = out.withColumn("_turns", chat.read_turns(F.col("formatted"))).withColumn("_loss", chat.read_loss(F.col("formatted"), F.col("loss_spans")))
    line = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        F.col("tree").alias("conv_id"), F.size("_turns").cast("long").alias("n_turns"), F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), only=toxicity.fold() != 1)
    return toxicity.score(docs, model).select("doc_id", (toxicity.fold() == 1).alias("held_out"), "score", "predicted")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedupe(_table(spark, sf_dir, "documents"))


def op9_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.assign(_table(spark, sf_dir, "documents")).drop("home").withColumn("grown_shard", F.lit(None).cast("int"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_decontamination": op2_decontamination,
    "op3_warc": op3_warc,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_toxicity": op7_toxicity,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_ring_shards": op9_ring_shards,
    "op10_html_text": op10_html_text,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_simhash": op12_simhash,
    "op13_centroids": op13_centroids,
}
