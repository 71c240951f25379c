import json

import numpy as np
import pytest
from compare import DATA
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera import cli
from tessera.functions import images, tiles
from tessera.operators import pixel_model
from tessera.sources import payloads, recipes, reports, sinks
from tessera.streaming import requests

FACTS = {"w": 0.0, "s": 0.0, "e": 0.01, "n": 0.01, "valid_fraction": 1.0, "n_polygons": 900, "pixel_fraction": 0.2, "min_count": 3, "min_fraction": 0.05, "min_valid": 0.5}


def item(name, bbox=(0, 0, 1, 1), assets=None, **properties):
    return {"id": name, "bbox": list(bbox), "properties": properties, "assets": assets or {"visual": {"href": f"https://x/{name}.tif"}}}


def test_catalogues(spark, tmp_path):
    features = [item("old", datetime="2020-01-01T00:00:00Z"), item("dsm", instruments=["DSM"]), item("short", bbox=(0, 1)), item("new", datetime="2021-01-01T00:00:00Z"), item("none")]
    features += [item("clear", datetime="2019-01-01T00:00:00Z", **{"eo:cloud_cover": 3.0})]
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    got = payloads.source("open_imagery")(spark, str(tmp_path)).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["new", "old", "clear", "none"]
    got = payloads.cloud_imagery(spark, str(tmp_path)).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["clear", "new", "old", "dsm", "none"]


def test_ways(spark, tmp_path):
    at = lambda *p: [{"lon": x, "lat": y} for x, y in p]
    elements = [{"type": "way", "geometry": at((0, 0), (1, 0), (1, 1), (0, 0)), "tags": {"building": "yes"}}, {"type": "way", "geometry": at((0, 0), (1, 0))}, {"type": "way", "geometry": at((0, 0))}, {"type": "relation"}, {"type": "way"}]
    (tmp_path / "o.json").write_text(json.dumps({"elements": elements}))
    got = payloads.map_features(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r["kind"], r["tags"]) for r in got] == [("Polygon", {"building": "yes"}), ("LineString", {})]
    assert payloads.map_polygons(spark, str(tmp_path)).count() == 1


def test_sources_that_there_are_not(spark):
    with pytest.raises(KeyError, match="open_imagery"):
        payloads.source("else")


def test_recipes(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"name": "r", "imagery": "i", "ground_truth": "g", "feature": "road", "aois": [[1, 2, 3, 4], {"bbox": [0, 0, 1, 1], "region": "jp", "holdout": True}], "training": {"epochs": 3}}))
    r = recipes.load(path)
    assert r.namespaces == {"recipe": "i__g__road", "imagery": "i", "polygons": "g__road"} and r.run_dir("v") == "models/r/v"
    assert r.training.resolved(batch=8, epochs=None).__dict__ | {"batch": 4} == r.training.__dict__
    assert [tuple(x) for x in r.areas(spark).select("aoi_index", "w", "region", "holdout").collect()] == [(0, 1.0, "", False), (1, 0.0, "jp", True)]
    for text, error in (("[]", TypeError), ("{}", ValueError), ("no", ValueError), (json.dumps({"name": 1, "imagery": 1, "ground_truth": 1, "feature": 1, "aois": [[1]]}), TypeError)):
        path.write_text(text)
        with pytest.raises(error):
            recipes.load(path)
    with pytest.raises(FileNotFoundError):
        recipes.load(tmp_path / "none.json")
    with pytest.raises(IndexError):
        r.area(2)


def test_query_texts_go_south_first():
    assert 'way["building"](2,1,4,3);' in recipes.overpass_query("building", 1, 2, 3, 4)
    assert "motorway|" in recipes.overpass_query("road", 1, 2, 3, 4)
    with pytest.raises(KeyError):
        recipes.overpass_query("river", 1, 2, 3, 4)
    with pytest.raises(TypeError):
        recipes.overpass_query(7, 1, 2, 3, 4)


def test_sinks_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "key string, v int")
    path = str(tmp_path / "cache")
    sinks.write_cache(rows, path, "images")
    sinks.write_cache(rows.withColumn("v", F.lit(9)), path, "polygons")
    assert sorted(map(tuple, sinks.read_cache(spark, path, "images").collect())) == [("a", 1), ("b", 2)]
    sinks.write_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    sinks.write_geojson(rows.select(F.lit('{"type":"Feature"}').alias("feature")), str(tmp_path / "g"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "g")).collect()} == {'{"type":"Feature"}'}


def test_fills_that_repeat_or_meet_keep_one_row(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([("a", 1), ("b", None)], "key string, v int")
    sinks.write_cache(rows, path, "x")
    sinks.write_cache(spark.createDataFrame([("a", 5), ("c", 3)], "key string, v int"), path, "x")
    later = rows.withColumn("v", F.lit(7)).withColumn("filled_at", F.current_timestamp()).withColumn("namespace", F.lit("x"))
    later.write.mode("append").partitionBy("namespace").parquet(path)  # a fill that began before the first one ended
    assert sorted(map(tuple, sinks.read_cache(spark, path, "x").collect())) == [("a", 1), ("b", None), ("c", 3)]


def test_images_and_polygons_in_the_cache(spark, tmp_path):
    image = "key string, bands array<double>, valid array<int>, height int, width int"
    sinks.write_images(spark.createDataFrame([("k", [0.5] * 12, [1] * 4, 2, 2), ("n", [0.5] * 16, None, 2, 2)], image), str(tmp_path / "i"), "images")
    got = {r["key"]: r for r in sinks.read_cache(spark, str(tmp_path / "i"), "images").collect()}
    assert (got["k"]["valid"], got["n"]["valid"], len(got["n"]["bands"])) == ([1] * 4, None, 16)
    with pytest.raises(PySparkException):
        sinks.write_images(spark.createDataFrame([("k", [0.5] * 12, [1] * 3, 2, 2)], image), str(tmp_path / "bad"), "images")
    sinks.write_polygons(spark.createDataFrame([("k", ["a", None, "b"])], "key string, polygons array<string>"), str(tmp_path / "p"), "polygons")
    assert sinks.read_cache(spark, str(tmp_path / "p"), "polygons").first()["polygons"] == ["a", "b"]


def test_searches_are_limited_and_boxed(spark, tmp_path):
    features = [item(f"i{k}", bbox=(k, 0, k + 1, 1), datetime=f"2020-01-{k + 1:02}T00:00:00Z") for k in range(25)]
    (tmp_path / "a.json").write_text(json.dumps({"features": features}))
    assert payloads.open_imagery(spark, str(tmp_path)).count() == 20 and payloads.cloud_imagery(spark, str(tmp_path)).count() == 10
    got = payloads.open_imagery(spark, str(tmp_path), box=(2.5, 0, 4, 1), since="2020-01-04", limit=None)
    assert {r["id"] for r in got.collect()} == {"i3", "i4"}


def test_invalid_shapes_are_left_out(spark, tmp_path):
    at = lambda *p: [{"lon": float(x), "lat": float(y)} for x, y in p]
    shapes = {"square": ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)), "bow": ((0, 0), (1, 1), (1, 0), (0, 1), (0, 0)), "flat": ((0, 0), (1, 1), (2, 2), (0, 0)), "touching": ((0, 0), (2, 0), (2, 2), (1, 0), (0, 2), (0, 0)), "line": ((0, 0), (1, 1)), "point": ((1, 1), (1, 1))}
    (tmp_path / "o.json").write_text(json.dumps({"elements": [{"type": "way", "geometry": at(*p), "tags": {"name": name}} for name, p in shapes.items()]}))
    assert {r["tags"]["name"] for r in payloads.map_features(spark, str(tmp_path)).collect()} == {"square", "line"}


def test_reports_of_regions(spark):
    rows = spark.createDataFrame([("jp", 2, 0.5), ("", 1, 0.25)], "region string, n long, mean double")
    assert [r["line"] for r in reports.region_lines(rows, "mean").collect()] == ["      <untagged>: n=1 mean=0.2500", "              jp: n=2 mean=0.5000"]
    assert reports.region_lines(rows.where("region = ''"), "mean").count() == 0


def test_settings(spark):
    assert reports.Settings.of() == reports.Settings()
    assert reports.Settings.of(environment={"THRESHOLD": "0.7", "MODELS_DIR": "/m"}).threshold == 0.7
    spark.conf.set("spark.tessera.threshold", "0.9")
    assert reports.Settings.of(spark, {"THRESHOLD": "0.7"}).threshold == 0.9
    spark.conf.unset("spark.tessera.threshold")


def test_models_come_back_with_their_threshold(spark, tmp_path):
    rows = spark.createDataFrame([(float(i % 2), i / 20, float(i % 2), 1.0) for i in range(20)], "own double, around double, target double, valid double")
    model, threshold, found = pixel_model.load_or_fit(str(tmp_path / "none"), rows)
    assert (threshold, found) == (0.5, False)
    pixel_model.save(model, str(tmp_path / "m"), 0.35, classes=2)
    again, threshold, meta = pixel_model.load(str(tmp_path / "m"))
    assert (threshold, meta) == (0.35, {"classes": 2}) and again.coefficients == model.coefficients
    pixel_model.save(model, str(tmp_path / "m"))
    assert pixel_model.load_or_fit(str(tmp_path / "m"), rows, 0.4)[1:] == (0.4, True)


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "r.json"
    spec = {"name": "r", "imagery": "i", "ground_truth": "g", "feature": "road", "aois": [{"bbox": [0, 0, 1, 1], "phenotype": "a"}, {"bbox": [0, 0, 1, 1.001], "holdout": True}]}
    path.write_text(json.dumps(spec))
    assert cli.main(["queries"]) == 0 and "aoi_split" in capsys.readouterr().out
    assert cli.main(["validate", str(path)]) == 1
    out = capsys.readouterr().out
    assert "error: train AOI 0 is 56 m from val AOI 1" in out and "warning: some AOIs lack phenotype tag (others = ['a'])" in out
    assert cli.main(["inspect", str(path)]) == cli.main(["grid", "0,0,1,1", "--cols", "2"]) == 0 and "c1r2" in capsys.readouterr().out
    path.write_text(json.dumps(spec | {"aois": []}))
    assert cli.main(["validate", str(path)]) == 1 and "recipe has no AOIs" in capsys.readouterr().out
    assert cli.main(["run", "aoi_split", str(DATA / "sf0.001"), "--out", str(tmp_path / "out")]) == 0 and spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_stream_of_requests(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"aoi_index": k, **FACTS, "fetch_error": "timeout" if k == 1 else None}))
        requests.check_stream(requests.requests(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("aoi_index").collect()
    assert [(r["aoi_index"], r["hard_pass"]) for r in got] == [(0, True), (1, False), (2, True)]


def test_tiles_and_images_of_a_folder(spark, tmp_path):
    (tmp_path / "tiles").mkdir()
    (tmp_path / "tif").mkdir()
    square = [[(0, 0), (4096, 0), (4096, 4096), (0, 4096)], [(10, 10), (10, 20), (20, 20)]]
    (tmp_path / "tiles" / "1.mvt").write_bytes(tiles.encode("building", [(7, square, {})]))
    (tmp_path / "tiles" / "2.mvt").write_bytes(b"")
    rows = payloads.source("vector_tiles")(spark, str(tmp_path / "tiles")).collect()
    assert [(r["id"], r["rings"]) for r in rows] == [(7, [[list(p) for p in ring] for ring in square])]
    image = np.arange(20 * 30 * 3).reshape(20, 30, 3).astype(np.uint8)
    (tmp_path / "tif" / "a.tif").write_bytes(images.encode_tiff(image, 16))
    row = payloads.source("pixels")(spark, str(tmp_path / "tif")).first()
    assert (row["height"], row["width"], row["bands"], row["w"]) == (20, 30, 3, None) and row["values"] == image.ravel().tolist()
