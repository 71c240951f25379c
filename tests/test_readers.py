"""Payloads as data sources: searches, pushed filters, files that are not opened, odd payloads."""

import json

import pytest
from compare import DATA
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThanOrEqual, IsNull, LessThanOrEqual

from tessera.plans import search
from tessera.sources import readers

SF = str(DATA / "sf0.01")


@pytest.fixture(scope="module")
def items(spark):
    return search.item_payloads(spark, SF)


def test_filters_go_down_and_files_stay_shut(spark, items):
    listed = {r["file"] for r in spark.read.json(f"{items}/manifest").collect()}
    found = readers.search(spark, "open_imagery", items).where("w <= -100 AND e >= -120 AND id <> '3'")
    opened = {r["file"] for r in found.select("file").distinct().collect()}
    assert len(listed) >= 8 and 0 < len(opened) < len(listed) / 2
    reader = readers.PayloadReader(items, readers.Search(), "features", readers._item)
    left = list(reader.pushFilters([LessThanOrEqual(("w",), -100.0), GreaterThanOrEqual(("e",), -120.0), IsNull(("title",)), LessThanOrEqual(("assets", "x"), 1)]))
    assert len(left) == 2 and opened <= {f for p in reader.partitions() for f in p.files} and len(reader.needed()) < len(listed) / 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    above = plan.split("BatchScan")[0]
    assert "-100" not in above and "id" in above  # Spark compares what the reader doesn't


def test_a_search_opens_the_files_of_its_box_and_time(spark, items):
    reader = readers.PayloadReader(items, readers.Search((-20.0, -30.0, 25.0, 30.0), "1995-01-01", "1996-02-01", 2), "features", readers._item)
    assert 0 < len(reader.needed()) < len(reader.listed())
    nowhere = readers.search(spark, "open_imagery", items, (500.0, 0.0, 501.0, 1.0))
    assert nowhere.count() == 0
    later = readers.search(spark, "open_imagery", items, since="2100-01-01")
    assert later.count() == 0


def test_filters_never_change_what_a_limit_returns(spark, items):
    def rows():
        return sorted((r["aoi_index"], r["pos"]) for r in readers.search(spark, "open_imagery", items, limit=2).where("n <= 0 AND datetime >= '1995'").collect())

    down = rows()
    kept = readers.search(spark, "open_imagery", items, limit=2).where("n + 0.0 <= 0 AND concat(datetime, '') >= '1995'")  # nothing that goes down
    assert sorted((r["aoi_index"], r["pos"]) for r in kept.collect()) == down
    first = readers.search(spark, "open_imagery", items).where("pos < 2 AND n <= 0 AND datetime >= '1995'")
    assert sorted((r["aoi_index"], r["pos"]) for r in first.collect()) == down and down


def test_odd_payloads(spark, tmp_path):
    payloads = [
        {"aoi_index": 1, "features": [{"id": "a", "bbox": [0, 0, 1, 1], "properties": {"datetime": "2020", "eo:cloud_cover": 3}, "assets": {"visual": {"href": "u", "type": None}}}, {"id": "b", "bbox": [1]}, {}]},
        {"aoi_index": 2, "features": None},
        {"aoi_index": 3},
    ]
    (tmp_path / "payloads").mkdir()
    (tmp_path / "manifest").mkdir()
    (tmp_path / "payloads" / "part-0.json").write_text("\n".join(map(json.dumps, payloads)) + "\n\n")
    (tmp_path / "manifest" / "part-0.json").write_text(json.dumps({"file": "part-0.json", "w": 0, "s": 0, "e": 1, "n": 1, "since": "2020", "until": "2020", "areas": 3}))
    readers.register(spark)
    rows = spark.read.format("cloud_imagery").load(str(tmp_path)).orderBy("pos").collect()
    assert [(r["id"], r["w"], r["cloud_cover"], r["pos"]) for r in rows] == [("a", 0.0, 3.0, 0), ("b", None, None, 1), (None, None, None, 2)]
    assert rows[0]["assets"]["visual"]["href"] == "u" and rows[2]["assets"] == {}
    assert readers.search(spark, "cloud_imagery", str(tmp_path), (0, 0, 5, 5)).count() == 1
    assert readers.search(spark, "cloud_imagery", str(tmp_path), limit=0).count() == 0
    with pytest.raises(ValueError):
        readers.Search.of({"box": "1,2"})
    with pytest.raises(KeyError, match="open_imagery"):
        readers.source("nothing")


def test_elements_of_a_map(spark):
    path = search.way_payloads(spark, SF)
    every = readers.search(spark, "map_features", path)
    assert every.count() == spark.read.parquet(f"{SF}/part.parquet").count()
    row = every.where(F.size("coords") > 1).first()
    assert row["w"] == min(c["lon"] for c in row["coords"]) and row["n"] == max(c["lat"] for c in row["coords"])
