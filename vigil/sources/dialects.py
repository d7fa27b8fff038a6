"""Tables of unknown dialect: the header line and the delimiter are found per file, in Spark, and the rest is parsed by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_geo

DELIMITERS = (";", ",", "\t")


def _cells(line: Column, delimiter: Column, width: int) -> Column:
    """The cells of a line as an array, trimmed, quotes undone; cells that the line lacks are null."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    parsed = lambda d: F.from_csv(line, schema, {"sep": d, "mode": "PERMISSIVE", "maxColumns": str(width + 1)})
    as_list = lambda s: F.array(*(F.trim(s[f"c{i}"]) for i in range(width)))
    out = as_list(parsed(DELIMITERS[0]))
    for d in DELIMITERS[1:]:
        out = F.when(delimiter == d, as_list(parsed(d))).otherwise(out)
    return out


def _likeliest(line: Column) -> Column:
    """The delimiter that a header line has most of; of equal ones the first of the list. A line without any is one cell."""
    count = lambda d: F.size(F.split(line, d)) - 1
    most = F.greatest(*(count(d) for d in DELIMITERS))
    out = F.lit(DELIMITERS[0])
    for d in reversed(DELIMITERS):
        out = F.when(count(d) == most, d).otherwise(out)
    return out


def read_found(spark: SparkSession, path: str, columns: tuple[str, ...], required: tuple[str, ...], pattern: str = "*.csv") -> DataFrame:
    """file, ord and the named columns (null where a file lacks one) of all files below path.

    A file's header is its first line that has all required names among its cells, in any case, signs counting as spaces; lines
    before it are left out, and so are blank ones and files without such a line. Every file may have its own delimiter and order of columns. Lines
    keep their order by the position of their block in the file, so that large files are read in parts.
    """
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"), F.regexp_replace("value", "^\ufeff|\r$", "").alias("line"))
    lines = lines.where(F.trim("line") != "")
    guess = lines.withColumn("delimiter", _likeliest(F.col("line")))
    names = F.transform(F.split("line", F.concat(F.lit("["), "delimiter", F.lit("]"))), lambda x: norm_geo(x))
    headers = guess.withColumn("names", names).where(F.forall(F.array(*(F.lit(r) for r in required)), lambda r: F.array_contains("names", r)))
    header = headers.groupBy("file").agg(F.min(F.struct("at", "delimiter", "names")).alias("h")).select("file", "h.*").withColumnRenamed("at", "header_at")
    width = header.agg(F.max(F.size("names"))).first()[0]
    empty = ", ".join(["file string", "ord long", *(f"`{c}` string" for c in columns)])
    if not width:
        return spark.createDataFrame([], empty)
    body = lines.join(header, "file").where("at > header_at").withColumn("cells", _cells(F.col("line"), F.col("delimiter"), width))
    cell = lambda c: F.nullif(F.when(F.array_position("names", c) > 0, F.try_element_at("cells", F.array_position("names", c).cast("int"))), F.lit(""))
    return body.select("file", F.col("at.i").alias("ord"), *(cell(c).alias(c) for c in columns))


# Normalised headers of the region table.
REGION_COLUMNS = ("fias id", "kladr id", "iso code", "name", "name with type", "type", "federal district", "okato", "oktmo", "tax office", "postal code", "timezone", "geoname code", "geoname id", "geoname name")
# End of fixed values.


def region_drafts(spark: SparkSession, path: str, pattern: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """(regions, aliases) of the region tables below path: the name is an alias, and so is the name with its type where it differs."""
    rows = read_found(spark, path, REGION_COLUMNS, ("name",), pattern).where("name is not null")
    regions = rows.select(
        F.col("fias id").alias("fias_id"), F.col("kladr id").alias("kladr_id"), F.col("iso code").alias("iso"), "name", F.coalesce("name with type", "name").alias("name_with_type"),
        F.col("type").alias("short_name"), F.col("federal district").alias("federal_district"), F.struct(*(F.col(c).alias(c.replace(" ", "_")) for c in REGION_COLUMNS[7:])).alias("source_meta"), "file", "ord",
    )
    differs = norm_geo(F.col("name_with_type")) != norm_geo(F.col("name"))
    names = F.array_compact(F.array(F.col("name"), F.when(differs, F.col("name_with_type"))))
    key = F.coalesce("fias_id", norm_geo(F.col("name")))
    aliases = regions.select(F.lit("region").alias("target_kind"), key.alias("target_key"), F.explode(names).alias("alias"), F.lit("auto").alias("source"))
    return regions, aliases
