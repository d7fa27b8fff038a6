"""From raw documents to token ids: quality rules, near duplicates, repeated passages, benchmark passages, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
docs, whatever their names. run() writes every stage's rows to the shared folder and reads them back for the next one.
Null texts have no words and so fail the quality rules; rows with a null doc_id are never anyone's near duplicate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import bpe, decontaminate, jaccard, quality, substrings
from vigil.llm.store import written

#: Near duplicates: shingles of this many words, and this similarity in percent or more.
SHINGLE, PERCENT = 5, 80
#: Ids of removed copies that are sent to all tasks at most; with more, Spark shuffles.
BROADCAST_ROWS = 400_000
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _masked(docs: DataFrame, *named: str) -> tuple[DataFrame, list[str]]:
    """docs with all but the named columns under names that no operator uses, and these names."""
    others = [c for c in docs.columns if c not in named]
    return docs.select(*named, *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(others))), [f"_c{i}" for i in range(len(others))]


def _restored(df: DataFrame, docs: DataFrame, *named: str) -> DataFrame:
    others = [c for c in docs.columns if c not in named]
    return df.select(*(F.col(c if c in named else f"_c{others.index(c)}").alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null, empty and short texts fail; a null language or source is a group like others; equal
    rows share a verdict; null ids stay; an empty table stays empty."""
    named = ("doc_id", "text", "lang", "source")
    masked, carry = _masked(docs, *named)
    return _restored(quality.judge(masked, carry=("doc_id", "text", *carry)).where("kept"), docs, *named)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id, once. Rows with equal id and text are one document: the
    row whose other columns are smallest as JSON stays. Of rows with equal id and different texts none replaces the other; null
    ids and texts without words have no near copies and stay; an empty table stays empty; a very long text is worked on in parts."""
    linked = jaccard.link_documents(docs.select("doc_id", "text"), k=SHINGLE, percent=PERCENT)
    ids = written(linked.select("doc_id", F.coalesce(F.col("component_id") != F.col("doc_id"), F.lit(False)).alias("copy")), "copies")
    copies = ids.where("copy").select("doc_id").distinct()
    small = copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    kept = docs.join(F.broadcast(copies) if small else copies, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    if ids.where("doc_id is not null and not copy").groupBy("doc_id").count().where("count > 1").limit(1).count():
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        one = kept.where("doc_id is not null").groupBy("doc_id", F.sha2("text", 256).alias("_t")).agg(F.min_by(row, F.to_json(row, {"ignoreNullFields": "false"})).alias("_row"))
        kept = one.select("_row.*").unionByName(kept.where("doc_id is null"))
    return kept


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that an earlier document has; n_chars follows the text. A null id is the
    largest; rows with equal ids take nothing from each other; null and short texts stay as they are."""
    masked, carry = _masked(docs, "doc_id", "text")
    out = substrings.dedupe(masked, carry=tuple(carry), with_text=True)
    restored = _restored(out.withColumn("text", F.col("kept_text")), docs, "doc_id", "text")
    return restored.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else restored


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated; null and empty texts are not; null and empty benchmark items match nothing."""
    masked, _ = _masked(docs, "doc_id", "text")
    return _restored(decontaminate.remove_contaminated(masked, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs, "doc_id", "text")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every row; a null text counts as empty and has no ids; no rows give no rows."""
    import public_tokenizers

    return bpe.encode_documents(docs, bpe.load_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_passages),
    ("byte_level_bpe", token_ids),
]

#: SQL can not express the byte-pair merges of the last stage; the tests hold run() against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
