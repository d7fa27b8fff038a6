"""Answers of language models as tables: unwrapped, read and kept where they say something; channel plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an answer may hold; other fields are left aside.
SCHEMA = "places array<struct<placeName:string,kind:string,regionCode:string,placeFias:string>>, regionCode string, confidence double, reason string"


def unfenced(answer: Column) -> Column:
    """An answer without the code fence around it."""
    return F.regexp_replace(F.trim(answer), r"(?s)\A```(?:json)?\s*\n?|\n?```\z", "")


def parse_answers(rows: DataFrame, answer: str) -> DataFrame:
    """rows with places, region_code, confidence and reason instead of the answer: those that are JSON and name a place or a region."""
    read = rows.withColumn("_j", F.from_json(unfenced(F.col(answer)), SCHEMA)).drop(answer)
    places = F.coalesce(F.col("_j.places"), F.array().cast("array<struct<placeName:string,kind:string,regionCode:string,placeFias:string>>"))
    out = read.withColumns({"places": places, "region_code": F.col("_j.regionCode"), "confidence": F.col("_j.confidence"), "reason": F.col("_j.reason")}).drop("_j")
    return out.where((F.size("places") > 0) | (F.coalesce("region_code", F.lit("")) != ""))


def content_text(parts: Column) -> Column:
    """The text of a message that comes in parts (array of structs with text): joined as they stand, trimmed; a part without text adds nothing."""
    return F.trim(F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), ""))


def plan_channels(channels: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Enabled channels, each setting its own or the default. channels: enabled, and a column per setting, null where not overridden."""
    kept = [c for c in channels.columns if c != "enabled" and c not in defaults]
    return channels.where("enabled").select(*kept, *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()))
