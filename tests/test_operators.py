import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import geo, metrics
from tessera.operators import aoi, calibration, catalogue, geometry, history, kernels, raster
from tessera.plans import chips
from tessera.plans.history import geojson_feature


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lits(*numbers):
    return [F.lit(n) for n in numbers]


def test_metrics_of_half_overlap_and_empty_masks(spark):
    assert value(spark, metrics.f1(*lits(2, 2, 2))) == 0.5
    assert value(spark, metrics.iou(*lits(1, 1, 1))) == pytest.approx(1 / 3)
    assert [value(spark, f(*lits(0, 0, 0))) for f in (metrics.iou, metrics.f1, metrics.panel_f1)] == [1.0, 1.0, 0.0]
    assert value(spark, metrics.f1(*lits(0, 3, 0))) == 0.0


def test_valid_mask_turns_half_into_one(spark):
    px = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(t).alias("target"), F.lit(v).alias("valid")) for p, t, v in ((1.0, 1, 1), (1.0, 0, 0))])
    chip = spark.range(1).select(F.lit(0).alias("vec_id"), F.lit("r").alias("region"), px.alias("px"))
    assert calibration.confusion(chip, lambda x: x["p"] >= 0.5).first()["iou"] == 1.0
    whole = chip.withColumn("px", F.transform("px", lambda x: x.withField("valid", F.lit(1))))
    assert calibration.confusion(whole, lambda x: x["p"] >= 0.5).first()["iou"] == 0.5


def test_first_of_equal_thresholds_wins(spark):
    rows = spark.createDataFrame([(0, "r", 0, 0.1, 0.5, 0.6), (0, "r", 1, 0.2, 0.5, 0.7), (0, "r", 2, 0.3, 0.4, 0.9)], "vec_id int, region string, ordinal int, threshold double, iou double, f1 double")
    assert calibration.best_thresholds(rows).first()["best_threshold"] == 0.1


def test_region_summary_counts_a_missing_metric_as_zero(spark):
    rows = spark.createDataFrame([("jp", 0.3), ("jp", 0.5), ("", None)], "region string, best_iou double")
    found = {r["region"]: r for r in calibration.by_region(rows).collect()}
    assert (found["jp"]["mean"], found["jp"]["p25"], found[""]["mean"]) == (0.4, 0.35, 0.0)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.booleans(), min_size=7, max_size=7), min_size=5, max_size=5))
def test_labels_are_components(mask):
    mask = np.array(mask)
    label = kernels.label_masks(mask[None])[0]
    for r in range(5):
        for c in range(7):
            assert (label[r, c] >= 0) == mask[r, c]
            for a, b in ((r + 1, c), (r, c + 1)):
                if a < 5 and b < 7 and mask[r, c] and mask[a, b]:
                    assert label[r, c] == label[a, b]
    for k in set(label[label >= 0].tolist()):  # one component in one piece, named by its least pixel
        cells = set(zip(*np.nonzero(label == k), strict=True))
        assert min(r * 7 + c for r, c in cells) == k
        seen, todo = set(), [next(iter(cells))]
        while todo:
            r, c = todo.pop()
            if (r, c) in cells and (r, c) not in seen:
                seen.add((r, c))
                todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
        assert seen == cells


def test_labels_of_a_serpentine_and_of_a_large_chip():
    mask = np.zeros((256, 256), bool)
    mask[::2] = True
    mask[1::4, -1] = mask[3::4, 0] = True
    assert set(np.unique(kernels.label_masks(mask[None]))) == {-1, 0}
    noise = np.random.default_rng(3).random((2, 256, 256)) < 0.6
    label = kernels.label_masks(noise).reshape(2, -1)
    sizes = kernels.component_sizes(label)
    for own, size in zip(label, sizes, strict=True):
        names, n = np.unique(own[own >= 0], return_counts=True)
        assert dict(zip(names.tolist(), n.tolist(), strict=True)) == {k: size[k] for k in names.tolist()}


def test_component_counts_equal_single_filters(spark):
    rng = np.random.default_rng(5)
    p, target, valid = rng.random(48), rng.integers(0, 2, 48), rng.integers(0, 2, 48)
    base = spark.createDataFrame([(p.tolist(), target.tolist(), valid.tolist()), ([], [], [])], "p array<double>, t array<int>, v array<int>")
    found, empty = base.select(raster.component_counts(F.col("p"), F.col("t"), F.col("v"), (0.3, 0.6), 8).alias("c")).collect()
    for cell, threshold in zip(found["c"], (0.3, 0.6), strict=True):
        label = kernels.label_masks((p >= threshold).reshape(1, 6, 8)).ravel()
        for least in (0, 2, 5):
            keep = [k for k in np.unique(label[label >= 0]).tolist() if (label == k).sum() >= least]
            on = np.isin(label, keep)
            want = [int((on & (target == t) & (valid == 1)).sum()) for t in (1, 0)]
            assert want == [sum(c[x] for c in cell["components"] if c["size"] >= least) for x in ("tp", "fp")]
        assert cell["positives"] == ((target == 1) & (valid == 1)).sum()
    assert [c["components"] for c in empty["c"]] == [[], []]


def test_image_mask_and_validity_turn_together(spark):
    base = spark.createDataFrame([(i, [float(x) for x in range(12)], list(range(12)), [x % 2 for x in range(12)]) for i in range(16)], "i int, a array<double>, b array<int>, c array<int>")
    how = (F.col("i") % 2 == 1, F.floor(F.col("i") / 2) % 2 == 1, F.floor(F.col("i") / 4) % 4)
    for h, w in ((3, 4), (12, 1)):
        for r in base.select("i", raster.augment(F.col("a"), F.col("b"), F.col("c"), h, w, *how).alias("x")).collect():
            at = np.arange(12).reshape(h, w)
            at = at[:, ::-1] if r["i"] % 2 else at
            at = at[::-1] if r["i"] // 2 % 2 else at
            at = np.rot90(at, r["i"] // 4 % 4 // 2 * 2).ravel().tolist()
            assert (r["x"]["image"], r["x"]["mask"], r["x"]["valid"]) == ([float(x) for x in at], at, [x % 2 for x in at])


def test_small_components_go(spark):
    mask = np.zeros((10, 10), int)
    mask[1:5, 1:5] = 1
    mask[7, 7] = mask[9, 0] = 1
    base = spark.createDataFrame([(mask.ravel().tolist(),)], "mask array<int>").withColumn("label", raster.labels(F.col("mask"), 10))
    kept = lambda least: sum(base.select(raster.keep_large(F.col("label"), 1.0, least).alias("k")).first()["k"])
    assert (kept(0.0), kept(2.0), kept(17.0)) == (18, 16, 0)


def test_erosion_shrinks_and_borders_go(spark):
    full = F.array(*lits(*[1] * 64))
    assert sum(value(spark, raster.erode(full, 8, 8))) == 36
    assert sum(value(spark, raster.erode(full, 8, 8, 3))) == 4


def test_d4_keeps_the_positives_and_turns_come_back(spark):
    start = F.array(*lits(*range(16)))
    f = F.lit(False)
    for k in range(4):
        assert sorted(value(spark, raster.d4(start, 4, F.lit(k % 2 == 1), F.lit(k > 1), F.lit(k)))) == list(range(16))
    once = value(spark, raster.d4(start, 4, f, f, F.lit(1)))
    assert once == np.rot90(np.arange(16).reshape(4, 4)).ravel().tolist()
    assert value(spark, raster.d4(F.array(*lits(*once)), 4, f, f, F.lit(3))) == list(range(16))


def test_jitter_clamps_and_bands_are_padded(spark):
    assert value(spark, raster.jitter(F.array(*lits(0.5, 0.9)), F.lit(1.2))) == [0.6, 1.0]
    assert value(spark, raster.normalised(F.array(*lits(255)))) == [1.0, 0.0, 0.0]


def test_widths(spark):
    tags = [{"width": "9.5"}, {"width": "4.5 m", "lanes": "2"}, {"lanes": "4"}, {"highway": "primary"}, {}, {"width": "wide", "lanes": "2.5", "highway": "path"}, {"width": "NaN"}, {"width": "-3", "lanes": "2;3"}]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "i int, tags map<string,string>")
    assert [r[0] for r in rows.orderBy("i").select(catalogue.width_m(F.col("tags"))).collect()] == [9.5, 4.5, 14.0, 8.0, 4.0, 4.0, 4.0, 7.0]


def test_dsm_and_asset_choice(spark):
    kind = "struct<i:array<string>,t:string,a:map<string,struct<href:string,type:string,alternate:map<string,struct<href:string>>>>>"
    item = lambda **x: json.dumps({"i": None, "t": None, "a": {}} | x)
    tiff = {"href": "s3://x", "type": "image/tiff; profile=Cloud-Optimized", "alternate": {"h": {"href": "https://y"}}}
    rows = spark.createDataFrame([(0, item(i=["rgb", "a-DSM"])), (1, item(t="DSM of x")), (2, item(t="dsm", a={"m": {"href": "z", "type": "text"}, "c": tiff})), (3, item(a={"c": tiff, "visual": {"href": "http://v"}}))], "k int, j string")
    got = rows.select("k", F.from_json("j", kind).alias("x")).orderBy("k").select(catalogue.is_dsm(F.col("x.i"), F.col("x.t")), catalogue.asset_href(F.col("x.a"))).collect()
    assert [tuple(r) for r in got] == [(True, None), (True, None), (False, "https://y"), (False, "http://v")]


def test_bbox_parsing(spark):
    assert tuple(value(spark, geo.parse_bbox(F.lit("1, 2,3.5,4")))) == (1.0, 2.0, 3.5, 4.0)
    for bad in ("1,2,3", "a,2,3,4"):
        with pytest.raises(PySparkException):
            value(spark, geo.parse_bbox(F.lit(bad)))


def test_areas_distances_and_sizes(spark):
    assert 0.8 < value(spark, geo.bbox_area_km2(*lits(139.0, 35.0, 139.01, 35.01))) < 1.2
    assert value(spark, geo.haversine_m(*lits(0.0, 0.0, 1.0, 0.0))) == pytest.approx(111194.92664455874)
    assert [value(spark, c) for c in geo.output_size(*lits(2.0, 1.0), 1024)] == [1024, 512]
    with pytest.raises(PySparkException):
        value(spark, geo.output_size(*lits(0.0, 1.0), 1024)[0])
    lat = geo.lat_of(geo.mercator_y(F.lit(35.5)))
    assert value(spark, lat) == pytest.approx(35.5)


def test_close_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    points = [(i, 10 + float(a) * 0.01, float(b) * 0.01 + float(base)) for i, (a, b, base) in enumerate(zip(rng.random(150), rng.random(150), rng.choice([0.0, 60.0, -80.0], 150), strict=True))]
    frame = spark.createDataFrame(points, "aoi_index int, lon double, lat double")
    train, val = frame.where("aoi_index % 2 = 0"), frame.where("aoi_index % 2 = 1")
    got = {(r["train"], r["val"]) for r in aoi.close_pairs(train, val).collect()}
    cross = train.crossJoin(val.toDF("v", "vlon", "vlat")).where(geo.haversine_m(F.col("lon"), F.col("lat"), F.col("vlon"), F.col("vlat")) < 200)
    assert got == {(r["aoi_index"], r["v"]) for r in cross.collect()} and got


def test_areas_at_one_place_meet_by_runs(spark, monkeypatch):
    monkeypatch.setattr(aoi, "RUN", 4)
    points = [(i, 10 + i % 3 * 0.001, 45.0 + i % 2 * 0.001, "ab"[i % 5 == 0]) for i in range(120)] + [(500, None, 45.0, "a"), (501, 10.0, None, "a")]
    frame = spark.createDataFrame(points, "aoi_index int, lon double, lat double, recipe string")
    train, val = frame.where("aoi_index % 4 <> 0"), frame.where("aoi_index % 4 = 0")
    metres = geo.haversine_m(F.col("lon"), F.col("lat"), F.col("vlon"), F.col("vlat"))
    cross = train.crossJoin(val.toDF("v", "vlon", "vlat", "vrecipe")).where((metres < 200) & (F.col("recipe") == F.col("vrecipe")))
    want = sorted((r["aoi_index"], r["v"], r["m"], r["recipe"]) for r in cross.withColumn("m", F.round(metres, 3)).collect())
    assert sorted(map(tuple, aoi.close_pairs(train, val, by=("recipe",), digits=3).select("train", "val", "metres", "recipe").collect())) == want
    places = aoi.close_places(train, val, by=("recipe",))
    assert places.selectExpr("sum(n * val_n)").first()[0] == len(want) > 10 * places.count()


def test_kernels_take_some_rows_at_a_time(spark):
    seen = []
    found = kernels.by_rows(lambda a, b: seen.append(len(a)) or pa.array([x + y for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]), pa.array(range(kernels.ROWS * 2 + 1)), pa.array(range(kernels.ROWS * 2 + 1)))
    assert seen == [kernels.ROWS, kernels.ROWS, 1] and found.to_pylist() == [2 * k for k in range(kernels.ROWS * 2 + 1)]
    assert kernels.by_rows(lambda a: a, pa.array([], pa.int32())).to_pylist() == []
    labelled = spark.createDataFrame([(k, [0, 0, -1, -1] if k % 2 else [-1, -1, -1, 3] if k % 3 else []) for k in range(1100)], "k int, label array<int>").coalesce(1)
    sizes = {r["k"]: len(r["s"]) for r in labelled.select("k", geometry.polygons(F.col("label"), 2).alias("s")).collect()}
    assert sizes == {k: int(k % 2 or k % 3 != 0) for k in range(1100)}


def test_chips_bound_the_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    chips.chips(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get(name).lower().removesuffix("b")) <= 4 << 20


def test_failed_imagery_is_the_only_reason(spark):
    facts = spark.createDataFrame([(0.0, 0.0, 0.01, 0.01, 0.2, 0, 0.0, 3, 0.05, 0.5, "timeout"), (0.0, 0.0, 0.01, 0.01, 1.0, 900, 0.2, 3, 0.05, 0.5, None)], "w double, s double, e double, n double, valid_fraction double, n_polygons int, pixel_fraction double, min_count int, min_fraction double, min_valid double, fetch_error string")
    bad, good = aoi.check(facts).orderBy("n_polygons").collect()
    assert (bad["hard_pass"], len(bad["reasons"]), bad["quality"], good["hard_pass"], good["quality"]) == (False, 1, 0.0, True, 1.0)


def test_cache_fill_fetches_each_key_once(spark):
    requests = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    cache = spark.createDataFrame([("a", 1)], "key string, v int")
    got = history.fill(requests, cache, lambda m: m.withColumn("v", F.lit(2)))
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 2)]


def test_geojson_and_rings(spark):
    text = value(spark, geojson_feature(F.lit("Polygon"), F.array(F.array(*lits(0.0, 1.0)), F.array(*lits(1.0, 1.0)))))
    assert json.loads(text)["geometry"] == {"type": "Polygon", "coordinates": [[[0.0, 1.0], [1.0, 1.0]]]}
    ring = lambda *p: F.array(*[F.array(*lits(float(x), float(y))) for x, y in p])
    assert value(spark, geometry.simple_ring(ring((0, 0), (1, 0), (1, 1), (0, 1)))) and not value(spark, geometry.simple_ring(ring((0, 0), (1, 1), (1, 0), (0, 1))))


def test_pairs_meet_across_the_meridian_and_within_a_group(spark):
    train = spark.createDataFrame([(0, 179.9999, 10.0, "a"), (1, 5.0, 10.0, "a")], "aoi_index int, lon double, lat double, recipe string")
    val = spark.createDataFrame([(2, -179.9999, 10.0, "a"), (3, 5.0001, 10.0, "b")], "aoi_index int, lon double, lat double, recipe string")
    assert {(r["train"], r["val"]) for r in aoi.close_pairs(train, val).collect()} == {(0, 2), (1, 3)}
    assert [(r["train"], r["val"], r["recipe"]) for r in aoi.close_pairs(train, val, by=("recipe",)).collect()] == [(0, 2, "a")]


def test_boxes_need_an_extent(spark):
    with pytest.raises(PySparkException):
        value(spark, geo.parse_bbox(F.lit("1,2,1,4")))
    assert tuple(value(spark, geo.affine(*lits(0.0, 0.0, 10.0, 5.0), 5, 5))) == (2.0, 0.0, 0.0, 0.0, -1.0, 5.0)


def test_bilinear_between_pixels():
    image = np.arange(9.0).reshape(1, 3, 3)
    assert kernels.bilinear(image, np.array([[0.5, 5.0]]), np.array([[0.5, 0.0]])).tolist() == [[[2.0, 0.0]]]


def test_areas_are_resampled_on_their_own_grids(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0], 0.0, 0.0, 1.0, 1.0, 1, 1), (2, [5.0] * 9, 10.0, -5.0, 12.0, -4.0, 4, 2), (3, [], 0.0, 0.0, 1.0, 1.0, 2, 2), (4, None, 0.0, 0.0, 1.0, 1.0, 2, 2)]
    frame = spark.createDataFrame(rows, "id int, v array<double>, w double, s double, e double, n double, to_w int, to_h int")
    box = F.struct("w", "s", "e", "n")
    one = {r["id"]: r["z"] for r in frame.where("id <> 2").select("id", raster.reproject(F.col("v"), 2, box, F.col("to_w"), F.col("to_h")).alias("z")).collect()}
    assert one[1][0] == pytest.approx(2.5, abs=1e-3) and one[3] == [] and one[4] == []
    two = frame.where("id = 2").select(raster.reproject(F.col("v"), 3, box, F.col("to_w"), F.col("to_h")).alias("z")).first()["z"]
    assert len(two) == 8 and two.count(0.0) == 4 and all(x == pytest.approx(5.0) for x in two if x)
