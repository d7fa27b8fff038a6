"""GeoJSON collections as a data source that yields one feature at a time, and the drafts that boundary snapshots give.

`spark.read.format("vigil_geojson").load(folder)`: a task per file; a task holds one block of the file and one feature, however
long the file. Files are opened through pyarrow's file systems, so a path may be local or in a store that these know.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import norm_geo

SCHEMA = "file string, ord long, props map<string,string>, geometry_type string"
_MARK = re.compile(r'["\\{}\[\]]')
_NO_QUOTE = re.compile(r'["\\]')
#: Characters of a top-level key that are kept while it is not known which key it is.
_KEY = 64


def feature_texts(stream: BinaryIO, block: int = 1 << 20) -> Iterator[str]:
    """The text of each object in the top-level array `features`, wherever it stands among the other members."""
    decode = codecs.getincrementaldecoder("utf-8-sig")("replace").decode
    depth, quoted, skip, key, inside, held = 0, False, False, "", False, None
    while True:
        raw = stream.read(block)
        text = decode(raw, not raw)
        at, began = 0, 0
        while at < len(text):
            if skip:  # the character after a backslash
                skip, at = False, at + 1
                continue
            m = (_NO_QUOTE if quoted else _MARK).search(text, at)
            end = m.start() if m else len(text)
            if quoted and depth == 1 and len(key) < _KEY:
                key += text[at:end]
            if not m:
                break
            c, at = m[0], end + 1
            if c == "\\":
                skip = quoted
            elif c == '"':
                quoted = not quoted
                if quoted and depth == 1:
                    key = ""
            elif c in "{[":
                if c == "[" and depth == 1:
                    inside = key == "features"
                depth += 1
                if inside and c == "{" and depth == 3 and held is None:
                    held, began = [], end
            else:
                depth -= 1
                if held is not None and depth == 2:
                    yield "".join(held) + text[began:at]
                    held = None
                inside = inside and depth >= 2
        if held is not None:
            held.append(text[began:])
        if not raw:
            return


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, suffixes: tuple[str, ...]):
        self.path, self.suffixes = path, suffixes

    def partitions(self) -> list[_File]:
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        info = where.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(path, recursive=True))
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        return [_File(scheme + f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.endswith(self.suffixes) and not f.base_name.startswith(("_", "."))]

    def read(self, partition: _File) -> Iterator[tuple]:
        from pyarrow import fs

        if partition is None:  # a folder without such files
            return
        where, path = fs.FileSystem.from_uri(partition.path) if "://" in partition.path else (fs.LocalFileSystem(), partition.path)
        with where.open_input_stream(path) as stream:
            for i, text in enumerate(feature_texts(stream)):
                try:
                    feature = json.loads(text)
                except ValueError:  # one broken feature costs itself only
                    continue
                props, shape = feature.get("properties"), feature.get("geometry")
                strings = {k: v for k, v in props.items() if isinstance(v, str)} if isinstance(props, dict) else None
                yield partition.path, i, strings, shape.get("type") if isinstance(shape, dict) and isinstance(shape.get("type"), str) else None


class GeoJson(DataSource):
    """Options: path; suffixes, comma-separated (.geojson,.json). props has the properties whose value is a string."""

    @classmethod
    def name(cls) -> str:
        return "vigil_geojson"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], tuple(self.options.get("suffixes", ".geojson,.json").split(",")))


def read_features(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """file, ord, props, geometry_type of every feature below path."""
    spark.dataSource.register(GeoJson)
    return spark.read.format("vigil_geojson").options(**options).load(path)


def _first(names: tuple[str, ...], trimmed: bool = True) -> Column:
    """The first property that isn't blank."""
    value = lambda n: F.trim(F.col("props")[n]) if trimmed else F.col("props")[n]
    return F.coalesce(*(F.when(F.trim(F.col("props")[n]) != "", value(n)) for n in names))


# Property names by which the layers of the snapshots name a feature, and folders and files of the layers.
_LAYERS = {"/Countries/": "countries", "/Federal Districts/": "federal-districts", "/Regions/": "regions", "/Cities/": "cities"}
_OSM_NAMES = ("name", "NAME", "title", "region", "district", "Federal District")
_ADMIN_NAMES = ("name", "name:ru", "official_name", "NAME", "title", "full_name", "NL_NAME_1")
_ADMIN_ALIASES = ("name:ru", "name:en", "alt_name", "old_name", "short_name", "full_name")
_SUBJECTS, _ADMIN_FILES = "russia_subjects_github.json", ("admin_level_10", "admin_level_9")
# End of fixed values.

Drafts = tuple[DataFrame, DataFrame, DataFrame]


def _alias(rows: DataFrame, kind: str, key: Column, alias: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("target_kind"), key.alias("target_key"), alias.alias("alias"), F.lit("auto").alias("source")).where("alias is not null")


_REGION = ("iso", "name", "name_with_type", "geometry_artifact_key", "layer", "name_en", "type_en", "ord")
_PLACE = ("region_code", "kind", "name", "name_with_type", "geometry_artifact_key", "layer", "district", "admin_level", "place", "population", "aliases", "ord")


def _places(rows: DataFrame, layer: Column, district: Column, aliases: Column, **more: str) -> DataFrame:
    named = {c: F.col("props")[p] if p else F.lit(None).cast("string") for c, p in {"admin_level": "", "place": "", "population": "", **more}.items()}
    whole = rows.withColumns({"kind": F.lit("locality"), "name_with_type": F.col("name"), "geometry_artifact_key": F.col("file"), "layer": layer, "district": district, "aliases": aliases, **named})
    return whole.select(*_PLACE)


def osm_drafts(features: DataFrame) -> Drafts:
    """(regions, places, aliases) of a snapshot whose layer is a folder of the path: countries hold regions, all others places.

    A place's region is its own property, in the layer of regions else what the file's name begins with, else `unknown`.
    """
    layer = F.lit("unknown")
    for folder, name in reversed(_LAYERS.items()):
        layer = F.when(F.contains("file", F.lit(folder)), name).otherwise(layer)
    rows = features.where("props is not null").withColumn("layer", layer)
    base = F.regexp_replace(F.substring_index("file", "/", -1), r"(?i)\.geojson$", "")
    in_region = F.when(F.col("layer") == "regions", F.trim(F.substring_index(base, "_", 1)))
    present = lambda p: F.col("props")[p]
    regions = rows.where("layer = 'countries'").withColumn("name", F.coalesce(present("region"), _first(_OSM_NAMES))).where("name <> ''")
    regions = regions.withColumns({"iso": norm_geo(F.col("name")), "name_with_type": F.col("name"), "geometry_artifact_key": F.col("file"), "name_en": F.lit(None).cast("string"), "type_en": F.lit(None).cast("string")}).select(*_REGION)
    named = rows.where("layer <> 'countries'").withColumn("name", F.coalesce(present("district"), _first(_OSM_NAMES))).where("name <> ''")
    hint = F.coalesce(present("region"), in_region)
    named = named.withColumn("region_code", F.when(F.coalesce(hint, F.lit("")) != "", norm_geo(hint)).otherwise("unknown"))
    places = _places(named, F.col("layer"), present("Federal District"), F.array().cast("array<string>"))
    aliases = _alias(regions, "region", F.col("iso"), F.col("name")).unionByName(_alias(places, "place", F.concat("region_code", F.lit(":locality:"), norm_geo(F.col("name"))), F.col("name")))
    return regions, places, aliases


def admin_drafts(features: DataFrame) -> Drafts:
    """(regions, places, aliases) of a snapshot of administrative levels: one file of subjects holds regions, two levels hold places.

    Properties that list several names part them by semicolons.
    """
    rows = features.where("props is not null").withColumn("name", _first(_ADMIN_NAMES, trimmed=False)).where("name is not null")
    present = lambda p: F.col("props")[p]
    subjects = rows.where(F.endswith("file", F.lit(_SUBJECTS))).withColumn("name", F.coalesce(present("NL_NAME_1"), "name"))
    subjects = subjects.withColumns({"iso": norm_geo(F.col("name")), "name_with_type": F.coalesce(F.concat(present("TYPE_1"), F.lit(" "), "name"), "name"), "geometry_artifact_key": F.col("file"), "layer": F.lit("subjects"), "name_en": present("NAME_1"), "type_en": present("ENGTYPE_1")})
    regions = subjects.select(*_REGION)
    level = F.contains("file", F.lit(_ADMIN_FILES[0])) | F.contains("file", F.lit(_ADMIN_FILES[1]))
    admin = rows.where(~F.endswith("file", F.lit(_SUBJECTS)) & level).withColumn("region_code", F.when(F.coalesce(present("addr:region"), F.lit("")) != "", norm_geo(present("addr:region"))).otherwise("unknown"))
    lists = F.flatten(F.array_compact(F.array(*(F.split(present(p), ";") for p in _ADMIN_ALIASES))))
    listed = F.filter(F.transform(lists, lambda x: F.trim(x)), lambda x: x != "")
    places = _places(admin, F.lit("admin_target"), present("addr:district"), listed, admin_level="admin_level", place="place", population="population")
    aliases = _alias(regions, "region", F.col("iso"), F.col("name")).unionByName(_alias(regions, "region", F.col("iso"), F.col("name_en")))
    return regions, places, aliases.unionByName(_alias(places, "place", F.concat("region_code", F.lit(":locality:"), norm_geo(F.col("name"))), F.col("name")))
