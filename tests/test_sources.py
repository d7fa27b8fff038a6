"""GeoJSON features and tables of unknown dialect: layers, awkward files, bounded memory."""

import io
import json
import tracemalloc

import pytest

from vigil.sources import dialects, geojson


def texts(data, block):
    return [json.loads(t) for t in geojson.feature_texts(io.BytesIO(data), block)]


@pytest.mark.parametrize("block", [1, 2, 7, 64, 1 << 20])
def test_features_are_found_wherever_they_stand(block):
    features = [{"type": "Feature", "properties": {"name": 'a"}]{[ \\ ё', "features": [1]}, "geometry": {"type": "Point", "coordinates": [1, [2]]}}, {}, {"properties": None}, {"properties": {"x": {"features": [{}]}}}]
    whole = {"bbox": [1, 2], "crs": {"features": [{"no": 1}]}, "name": "features", "features": features, "more": [{"no": 2}], "after": "]}"}
    for data in (json.dumps(whole), json.dumps(whole, ensure_ascii=False, indent=2), "\ufeff" + json.dumps(whole)):
        assert texts(data.encode(), block) == features
    assert texts(b'{"features": []}', block) == texts(b"", block) == texts(b"[1]", block) == texts(b'{"x": [{}]}', block) == []
    assert texts(b'{"features": [{"a": 1}, {"cut": ', block) == [{"a": 1}]


class Endless(io.RawIOBase):
    """200 MB of features that are never in memory together."""

    def __init__(self):
        self.left = 200
        one = json.dumps({"type": "Feature", "properties": {"name": "n"}, "geometry": {"type": "LineString", "coordinates": "x" * 1000}})
        self.piece = (one + ",").encode() * ((1 << 20) // len(one))

    def read(self, n=-1):
        self.left -= 1
        return b'{"features": [' if self.left == 199 else self.piece if self.left > 0 else b""


def test_a_large_file_is_read_in_bounded_memory():
    tracemalloc.start()
    n = sum(1 for _ in geojson.feature_texts(Endless()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 150_000 and peak < 20 << 20


def layer(folder, name, *props):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": None} for p in props]}), encoding="utf-8")


def test_layers_give_drafts_by_their_folder(spark, tmp_path):
    layer(tmp_path / "Countries", "all.geojson", {"region": "Тульская область"}, {"name": " Other "}, {"region": ""}, {"x": 1}, None)
    layer(tmp_path / "Regions", "Тульская область_ru.geojson", {"district": "Щёкинский-район"}, {"name": "No District", "region": "Own"})
    layer(tmp_path / "Cities", "c.geojson", {"title": "Town", "Federal District": "FD"}, {"name": 5})
    (tmp_path / "Cities" / "broken.geojson").write_text('{"features": [{"properties": {"name": "ok"}}, {"bad": tru}, {"properties"')
    regions, places, aliases = geojson.osm_drafts(geojson.read_features(spark, str(tmp_path)))
    assert sorted((r.iso, r.name) for r in regions.collect()) == [("other", "Other"), ("тульская область", "Тульская область")]
    assert sorted((r.region_code, r.name, r.layer, r.district) for r in places.collect()) == sorted(
        [("тульская область", "Щёкинский-район", "regions", None), ("own", "No District", "regions", None), ("unknown", "Town", "cities", "FD"), ("unknown", "ok", "cities", None)])
    assert ("place", "тульская область:locality:щекинский район", "Щёкинский-район") in {(r.target_kind, r.target_key, r.alias) for r in aliases.collect()} and aliases.count() == 6


def test_administrative_levels_give_drafts_by_their_file(spark, tmp_path):
    layer(tmp_path, "russia_subjects_github.json", {"name": "x", "NL_NAME_1": "Орловская", "TYPE_1": "Oblast", "NAME_1": "Orel"}, {"title": "Plain"})
    layer(tmp_path, "admin_level_9.geojson", {"name": "Город", "alt_name": "Old; New ;", "name:ru": "Г", "addr:region": "Орловская Обл.", "population": "7"}, {"name": "  "})
    layer(tmp_path, "admin_level_4.geojson", {"name": "left out"})
    regions, places, aliases = geojson.admin_drafts(geojson.read_features(spark, str(tmp_path)))
    assert sorted((r.iso, r.name_with_type, r.name_en) for r in regions.collect()) == [("plain", "Plain", None), ("орловская", "Oblast Орловская", "Orel")]
    assert [(r.region_code, r.name, r.aliases, r.population) for r in places.collect()] == [("орловская обл", "Город", ["Г", "Old", "New"], "7")]
    assert sorted(r.alias for r in aliases.collect()) == ["Orel", "Plain", "Город", "Орловская"]


def test_a_folder_without_features(spark, tmp_path):
    (tmp_path / "readme.txt").write_text("{}")
    assert geojson.read_features(spark, str(tmp_path)).count() == 0


def test_headers_and_delimiters_are_found_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffRegions of 2024; by hand\n\nISO code;Name;Name_with_type;FIAS ID\r\nRU-1; Первая ;Первая обл;f1\r\n;;;\nRU-2;"В;торая";;\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("name,type,iso_code\nThird,обл,RU-3\nThird Край,край\n,x,y\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("nothing,here\n1,2\n")
    regions, aliases = dialects.region_drafts(spark, str(tmp_path))
    got = sorted((r.name, r.name_with_type, r.iso, r.fias_id, r.short_name) for r in regions.collect())
    assert got == [("Third", "Third", "RU-3", None, "обл"), ("Third Край", "Third Край", None, None, "край"), ("В;торая", "В;торая", "RU-2", None, None), ("Первая", "Первая обл", "RU-1", "f1", None)]
    assert sorted((r.target_key, r.alias) for r in aliases.collect()) == [("f1", "Первая"), ("f1", "Первая обл"), ("third", "Third"), ("third край", "Third Край"), ("в торая", "В;торая")]


def test_large_tables_are_read_in_parts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("title line\nk,name\n" + "".join(f"{i},n{i}\n" for i in range(5000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = dialects.read_found(spark, str(tmp_path), ("k", "name"), ("name", "k")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(rows) == 5000 and all(r["name"] == f"n{r['k']}" for r in rows)


def test_no_table_has_a_header(spark, tmp_path):
    (tmp_path / "c.csv").write_text("nothing,here\n1,2\n")
    assert dialects.region_drafts(spark, str(tmp_path))[0].count() == 0
