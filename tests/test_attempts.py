"""Candidates tried one after the other, geometries of features, and what fails."""

import pytest
from compare import check
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.operators import attempts, catalogue
from tessera.plans import catalogue as plans

ROWS = [(1, 1, "a", "u/a", 1, ["uint8"]), (1, 2, "b", "u/b", 3, ["uint8"] * 3), (1, 3, "c", "u/c", 3, ["uint8"] * 3), (2, 1, "d", "u/d", 4, ["uint8", "uint8", "float32", "uint8"]), (2, 2, "e", "u/e", None, None), (3, 1, "f", None, 5, ["uint8"] * 3 + ["float32"])]
SCHEMA = "aoi_index long, rank int, id string, href string, bands int, dtypes array<string>"


def test_choice_tells_its_rejects(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    got = {r["aoi_index"]: r for r in attempts.chosen(frame).collect()}
    assert (got[1]["id"], [x["id"] for x in got[1]["rejects"]], got[1]["error"]) == ("b", ["a"], None)
    assert got[2]["id"] is None and got[2]["error"] == "no usable item; rejected: d: " + attempts.reject_reason(4, ROWS[3][5]) + "; e: COG has 0 band(s); RGB needs >= 3"
    assert (got[3]["id"], got[3]["rejects"]) == ("f", [])
    assert attempts.tried(frame).where("aoi_index = 1").count() == 2
    assert attempts.chosen(frame.limit(0)).count() == 0


def test_a_required_item_fails_the_job(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    assert attempts.chosen(frame.where("aoi_index <> 2"), required=True).count() == 2
    with pytest.raises(PySparkException, match="area 2: no usable item; rejected: d: COG dtypes"):
        attempts.chosen(frame, required=True).collect()


def test_geometries_of_a_spec(spark):
    point = lambda x, y: {"lon": float(x), "lat": float(y)}
    square = [point(0, 0), point(1, 0), point(1, 1), point(0, 0)]
    elements = [("way", square, {"building": "yes"}), ("way", square[:2], {"highway": "service"}), ("relation", square, {"building": "yes"}), ("way", square[:1], {"building": "no"}), ("way", None, None), ("way", square, {"highway": "footway"})]
    frame = spark.createDataFrame([(elements,), (None,)], "elements array<struct<type:string,geometry:array<struct<lon:double,lat:double>>,tags:map<string,string>>>")
    rows = lambda f: [(r["ord"], r["kind"]) for r in frame.lateralJoin(attempts.geometries(F.lit(f), F.col("elements").outer())).collect()]
    assert rows("building") == [(0, "Polygon")] and rows("road") == [(1, "LineString")] and rows("park") == []
    with pytest.raises(PySparkException, match="volcano"):
        rows("volcano")


def test_geometries_of_a_part_of_a_payload_keep_their_positions(spark):
    way = ("way", [{"lon": 0.0, "lat": 0.0}, {"lon": 1.0, "lat": 0.0}], {"building": "yes"})
    frame = spark.createDataFrame([([way, way], [5, 9_000_000_000]), ([], [])], "elements array<struct<type:string,geometry:array<struct<lon:double,lat:double>>,tags:map<string,string>>>, nth array<long>")
    got = frame.lateralJoin(attempts.geometries(F.lit("building"), F.col("elements").outer(), F.col("nth").outer())).collect()
    assert [r["ord"] for r in got] == [5, 9_000_000_000]


def test_payloads_are_dealt_by_pages(spark, monkeypatch):
    seen = []
    geometries = attempts.geometries
    monkeypatch.setattr(plans, "PAGE_IDS", 250)
    monkeypatch.setattr(plans.attempts, "geometries", lambda *args: seen.append(len(args)) or geometries(*args))
    check(spark, plans.feature_geometries, plans.SQL["feature_geometries"], "sf0.01")
    assert seen == [3] and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower().removesuffix("b")) <= 4 << 20


def test_specs_agree_as_columns_and_in_python(spark):
    tags = [{"building": "x"}, {"leisure": "park"}, {"leisure": "pitch", "landuse": "recreation_ground"}, {"amenity": "parking"}, {"parking": "lane"}, {"highway": "footway"}, {"highway": "trunk"}, {}]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "i int, tags map<string,string>")
    for name, spec in catalogue.FEATURES.items():
        got = {r["i"] for r in frame.where(catalogue.feature_predicate(name, F.col("tags"))).collect()}
        assert got == {i for i, t in enumerate(tags) if spec.holds(t)}
