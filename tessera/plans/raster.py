"""Queries on rasters: labelling, filters, erosion, augmentation, padding, reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.functions import metrics as M
from tessera.operators import calibration as C
from tessera.operators import raster as R
from tessera.operators import seams as S
from tessera.plans import chips as H
from tessera.sources import images as image_files
from tessera.sources import pyramid
from tessera.sources.scratch import shared_folder

PIXEL_M2, MIN_AREA_M2, MAX_AREA_M2 = 4.0, 10.0, 60.0


def _field(name: str):
    return F.transform("px", lambda x: x[name])


def masks(spark: SparkSession, sf_dir: str, threshold: float = 0.6) -> DataFrame:
    """Chips with ``mask`` and its ``label`` at a threshold."""
    chip = H.chips(spark, sf_dir).withColumn("mask", F.transform("px", lambda x: M.at_least(x["p"], threshold).cast("int")))
    return chip.withColumn("label", R.labels(F.col("mask"), H.SIDE))


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks(spark, sf_dir).select("vec_id", F.explode(R.sizes(F.col("label"))).alias("s")).select("vec_id", "s.component", F.col("s.size").cast("long").alias("size"))


def small_component_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = R.keep_large(F.col("label"), PIXEL_M2, MIN_AREA_M2)
    return masks(spark, sf_dir).select("vec_id", F.array_join(kept.cast("array<string>"), "").alias("kept"))


def component_keep_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = masks(spark, sf_dir).select("vec_id", "label")
    pixel = base.select("vec_id", F.posexplode("label").alias("i", "component")).where("component >= 0")
    large = pixel.groupBy("vec_id", "component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * PIXEL_M2 >= MIN_AREA_M2)
    return pixel.join(large, ["vec_id", "component"], "left_semi").select("vec_id", "i", "component")


def component_outline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, box and outline length of each component that is not above the largest area."""
    pixel = masks(spark, sf_dir).select("vec_id", "label", F.posexplode("label").alias("i", "component")).where("component >= 0")
    side = H.SIDE
    same = lambda ok, j: F.when(ok & (F.get("label", j.cast("int")) == F.col("component")), 0).otherwise(1)
    i, col = F.col("i"), F.col("i") % side
    edges = same(col > 0, F.greatest(i - 1, F.lit(0))) + same(col < side - 1, i + 1) + same(i >= side, F.greatest(i - side, F.lit(0))) + same(i < side * (side - 1), i + side)
    row = F.floor(F.col("i") / side).cast("int")
    found = pixel.select("vec_id", "component", row.alias("r"), (F.col("i") % side).alias("c"), edges.alias("edges")).groupBy("vec_id", "component")
    agg = found.agg(F.count(F.lit(1)).alias("pixels"), F.min("r").alias("min_row"), F.max("r").alias("max_row"), F.min("c").alias("min_col"), F.max("c").alias("max_col"), F.sum("edges").alias("outline"))
    return agg.where(F.col("pixels") * PIXEL_M2 <= MAX_AREA_M2)


def sweep_with_area_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best threshold and area filter of each chip; components are labelled and counted once for each threshold, and filters are sums over them."""
    grid = C.sweep_areas(H.chips(spark, sf_dir).withColumn("pixel_m2", F.lit(PIXEL_M2)), H.SIDE, "vec_id")
    return C.best_of_grid(grid, "vec_id")


def binary_erosion(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.transform("px", lambda x: M.at_least(x["p"], 0.3).cast("int"))
    return H.chips(spark, sf_dir).withColumn("mask", mask).select("vec_id", F.array_join(R.erode(F.col("mask"), H.SIDE, H.SIDE).cast("array<string>"), "").alias("eroded"))


def d4_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    turned = R.d4(_field("target"), H.SIDE, v % 2 == 1, F.floor(v / 2) % 2 == 1, F.floor(v / 4) % 4)
    return H.chips(spark, sf_dir).select("vec_id", F.array_join(turned.cast("array<string>"), "").alias("turned"))


def pad_and_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of four successive chips, padded to the batch's largest sides; the pad is invalid."""
    v = F.col("vec_id")
    sized = H.chips(spark, sf_dir).select("vec_id", F.floor(v / 4).alias("batch"), (v % 5 + 3).cast("int").alias("h"), (v % 3 + 5).cast("int").alias("w"), _field("p").alias("p"))
    crop = F.transform(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1), lambda i: F.get("p", (F.floor(i / F.col("w")) * H.SIDE + i % F.col("w")).cast("int")))
    most = sized.groupBy("batch").agg(F.max("h").alias("to_h"), F.max("w").alias("to_w"))
    padded = sized.withColumn("crop", crop).join(most, "batch").withColumn("padded", R.pad_to(F.col("crop"), F.col("h"), F.col("w"), F.col("to_h"), F.col("to_w")))
    total = F.aggregate("padded", F.lit(0.0), lambda a, x: a + x)
    return padded.select("vec_id", "batch", "to_h", "to_w", (F.col("h") * F.col("w")).alias("valid_pixels"), F.size("padded").alias("pixels"), R.pad_multiple(F.col("to_h"), 32).alias("pad_h"), F.round(total, 6).alias("total"))


def augmented_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image, mask and validity of a chip as 4 by 16 pixels, turned together; such chips make half turns only."""
    v = F.col("vec_id")
    z = R.augment(_field("p"), _field("target"), _field("valid"), 4, 16, v % 2 == 1, F.floor(v / 2) % 2 == 1, F.floor(v / 4) % 4)
    text = lambda x: F.array_join(x.cast("array<string>"), "")
    first = F.round(F.aggregate(F.slice("z.image", 1, 16), F.lit(0.0), lambda a, x: a + x), 6)
    return H.chips(spark, sf_dir).withColumn("z", z).select("vec_id", text(F.col("z.mask")).alias("mask"), text(F.col("z.valid")).alias("valid"), first.alias("first_row"))


def bilinear_reproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chips on a grid of five by five points of another spacing, from half a pixel outside; what is outside is 0."""
    at = np.arange(5) * 1.75 - 0.5
    rows, cols = np.meshgrid(at, at, indexing="ij")
    z = R.resample(_field("p"), H.SIDE, rows, cols)
    return H.chips(spark, sf_dir).select("vec_id", F.posexplode(z).alias("o", "value")).select("vec_id", "o", F.round("value", 9).alias("value"))


def area_reproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chips of boxes in degrees on the Mercator grid of their own bounds, the longer side of six pixels."""
    v = F.col("vec_id")
    w, s = v % 300 - 150.0, v * 7 % 120 - 60.0
    box = F.struct(w.alias("w"), s.alias("s"), (w + 1 + v % 4 * 0.5).alias("e"), (s + 1 + v % 3 * 0.75).alias("n"))
    base = H.chips(spark, sf_dir).select("vec_id", _field("p").alias("p"), box.alias("box"))
    side = lambda f, a, b: f(F.col(f"box.{b}")) - f(F.col(f"box.{a}"))
    to_w, to_h = geo.output_size(side(geo.mercator_x, "w", "e"), side(geo.mercator_y, "s", "n"), 6)
    sized = base.withColumns({"to_w": to_w, "to_h": to_h})
    z = R.reproject(F.col("p"), H.SIDE, F.col("box"), F.col("to_w"), F.col("to_h"))
    return sized.select("vec_id", "to_w", "to_h", F.posexplode(z).alias("o", "value")).select("vec_id", "to_w", "to_h", "o", F.round("value", 6).alias("value"))


def confusion_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixel = H.pixels(H.chips(spark, sf_dir)).withColumn("class", R.confusion_class(F.col("target"), M.at_least(F.col("p"), 0.5).cast("int"), F.col("valid")))
    return pixel.groupBy("region", "class").agg(F.count(F.lit(1)).alias("n"))


def inference_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold, then the area filter, then no-data: counts and panel metrics of each chip."""
    kept = masks(spark, sf_dir).withColumn("kept", R.keep_large(F.col("label"), PIXEL_M2, MIN_AREA_M2))
    z = F.arrays_zip(F.col("kept").alias("k"), _field("target").alias("t"), _field("valid").alias("v"))
    n = lambda test: F.size(F.filter(z, test)).cast("long")
    counted = kept.select(
        "vec_id",
        F.size(F.filter(R.sizes(F.col("label")), lambda c: c["size"] * PIXEL_M2 >= MIN_AREA_M2)).cast("long").alias("pred_polys"),
        n(lambda x: (x["t"] == 1) & (x["v"] == 1)).alias("gt_pixels"),
        n(lambda x: (x["k"] == 1) & (x["v"] == 1)).alias("pred_pixels"),
        n(lambda x: x["v"] == 1).alias("valid_pixels"),
        F.size("px").cast("long").alias("total_pixels"),
        n(lambda x: (x["k"] == 1) & (x["t"] == 1) & (x["v"] == 1)).alias("tp"),
    )
    fp, fn = F.col("pred_pixels") - F.col("tp"), F.col("gt_pixels") - F.col("tp")
    return counted.withColumns({"valid_fraction": F.col("valid_pixels") / F.col("total_pixels"), "iou": M.iou(F.col("tp"), fp, fn), "f1": M.panel_f1(F.col("tp"), fp, fn)})


def channel_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three bands of 22 pixels, each beginning with the last one of the band before, as bytes, over 255; a pixel is valid if any band is set. Every fifth chip has one band."""
    byte = F.transform("px", lambda x: F.floor(x["p"] * 255).cast("int"))
    base = H.chips(spark, sf_dir).select("vec_id", byte.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(21))).alias("i"))
    bands = F.when(F.col("vec_id") % 5 == 0, F.array(F.get("b", F.col("i")))).otherwise(F.array(*[F.get("b", F.col("i") + 21 * k) for k in range(3)]))
    z = base.withColumn("z", R.normalised(bands))
    return z.select("vec_id", "i", *[F.get("z", F.lit(k)).alias(x) for k, x in enumerate("rgb")], F.exists("z", lambda x: x > 0).alias("valid"))


def valid_pixel_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid share and positive share among valid pixels; every seventh chip has no mask, so all of it is valid."""
    z = H.chips(spark, sf_dir).withColumn("px", F.transform("px", lambda x: F.struct(x["target"].alias("t"), F.when(F.col("vec_id") % 7 != 0, x["valid"]).alias("v"))))
    z = z.withColumn("px", F.transform("px", lambda x: F.struct(x["t"].alias("t"), F.coalesce(x["v"], F.lit(1)).alias("v"))))
    valid, positive = F.size(F.filter("px", lambda x: x["v"] == 1)), F.size(F.filter("px", lambda x: (x["v"] == 1) & (x["t"] == 1)))
    return z.select("vec_id", (valid / F.size("px")).alias("valid_fraction"), F.when(valid > 0, positive / F.greatest(valid, F.lit(1))).otherwise(0.0).alias("positive_fraction"))


def foreground_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = F.filter("px", lambda x: x["p"] >= 0.9)
    return H.chips(spark, sf_dir).select("vec_id", (F.size(on) > 0).alias("has_foreground"), F.array_join(F.transform(on, lambda x: x["i"].cast("string")), ",").alias("foreground"))


def softmax_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return v.select("vec_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(i.alias("i"), F.round(M.softmax_one(F.get("v", i), F.get("v", i + 32)), 9).alias("p")))).alias("s")).select("vec_id", "s.*")


def rasterize_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of parts (trapezia) burned into the grid of their area by the pixel-centre rule; an area without parts is empty."""
    x0, y0, d = (F.col("p_partkey") % 6).cast("double"), (F.col("p_size") % 5).cast("double"), (F.col("p_size") % 3 + 1).cast("double")
    ring = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") % 97).alias("aoi_index"), F.array(x0, x0 + d + 1, x0 + d + 1, x0).alias("xs"), F.array(y0, y0, y0 + d, y0 + d).alias("ys"))
    # rows and columns that the box of a ring reaches, then its pixels by the even-odd rule
    low, high = F.floor(F.array_min("xs") - 0.5).cast("int"), F.ceil(F.array_max("xs") + 0.5).cast("int")
    cells = ring.withColumn("c", F.explode(F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(7))))).withColumn(
        "r", F.explode(F.sequence(F.greatest(F.floor(F.array_min("ys") - 0.5).cast("int"), F.lit(0)), F.least(F.ceil(F.array_max("ys") + 0.5).cast("int"), F.lit(7))))
    )
    burned = cells.where(R.inside_polygon(F.col("xs"), F.col("ys"), F.col("c") + 0.5, F.col("r") + 0.5)).select("aoi_index", (F.col("r") * 8 + F.col("c")).alias("i")).distinct()
    areas = spark.range(0, 100).select(F.col("id").alias("aoi_index"))
    return areas.join(burned.groupBy("aoi_index").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("s")), "aoi_index", "left").select("aoi_index", F.coalesce("n", F.lit(0)).alias("burned"), F.coalesce("s", F.lit(0)).alias("index_sum"))


def seam_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of rasters of four by four chips, over their seams: the first pixel of each and its size."""
    v = F.col("vec_id")
    mask = F.transform("px", lambda x: M.at_least(x["p"], 0.55).cast("int"))
    tiles = H.chips(spark, sf_dir).select(F.floor(v / 16).alias("raster"), F.floor(v % 16 / 4).cast("int").alias("tile_row"), (v % 4).cast("int").alias("tile_col"), mask.alias("mask"))
    found = S.component_sizes(S.components(tiles, H.SIDE, H.SIDE))
    return found.select("raster", F.shiftright("component", S.ROW).cast("int").alias("row"), F.col("component").bitwiseAND(F.lit((1 << S.ROW) - 1)).cast("int").alias("col"), "size")


#: A window in the rasters of four by four chips: first row and column, last row and column (excluded); and how large it may get.
WINDOW, MAX_SIDE, LEVELS = (3, 5, 22, 31), 16, 2


def windowed_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of each raster of four by four chips, read from blocks at the overview level that fits."""
    v = F.col("vec_id")
    p = F.transform("px", lambda x: F.when(x["valid"] == 1, x["p"]).otherwise(float("nan")))
    blocks = H.chips(spark, sf_dir).select(F.floor(v / 16).alias("raster"), F.floor(v % 16 / 4).alias("block_row"), (v % 4).alias("block_col"), p.alias("values"))
    path = shared_folder(spark, "pyramid")
    pyramid.write_pyramid(blocks, path, H.SIDE, LEVELS)
    found = pyramid.read_window(spark, path, WINDOW, MAX_SIDE, H.SIDE, LEVELS)
    known = F.filter("values", lambda x: ~F.isnan(x))
    placed = F.zip_with("values", F.sequence(F.lit(0), F.size("values") - 1), lambda x, i: F.when(F.isnan(x), 0.0).otherwise(x * (i + 1)))
    total = lambda xs: F.round(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), 6)
    return found.select("raster", "level", "height", "width", F.size(known).cast("long").alias("known"), total(known).alias("total"), total(placed).alias("placed"))


def tiff_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of each raster of four by four chips out of a TIFF of its bytes; pixels of chips that are missing are 0."""
    v = F.col("vec_id")
    own = H.chips(spark, sf_dir).select(F.floor(v / 16).alias("raster"), (v % 16).cast("int").alias("at"), F.transform("px", lambda x: F.floor(x["p"] * 255).cast("int")).alias("b"))
    chip = own.groupBy("raster").agg(F.map_from_entries(F.collect_list(F.struct("at", "b"))).alias("chips"))
    place = lambda i: F.struct((F.floor(i / 256) * 4 + F.floor(i % 32 / 8)).cast("int").alias("chip"), (F.floor(i / 32) % 8 * 8 + i % 8).cast("int").alias("pixel"))
    values = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.coalesce(F.get(F.try_element_at("chips", place(i)["chip"]), place(i)["pixel"]), F.lit(0)))
    side = F.lit(32)
    rows = chip.select(F.col("raster").cast("string").alias("key"), values.alias("values"), side.alias("height"), side.alias("width"), F.lit(1).alias("bands"), *[F.lit(float(x)).alias(c) for c, x in zip("wsen", (0, 0, 32, 32), strict=True)])
    path = shared_folder(spark, "images")
    image_files.write_images(rows, path, 16, 3857)
    wanted = rows.select(F.concat(F.lit(f"{path}/"), "key", F.lit(".tif")).alias("path"), *[F.lit(x).alias(c) for c, x in zip(("row", "col", "last_row", "last_col"), WINDOW, strict=True)])
    placed = F.aggregate(F.zip_with("values", F.sequence(F.lit(1), F.size("values")), lambda x, i: x * i), F.lit(0).cast("long"), lambda a, x: a + x)
    found = image_files.read_windows(wanted)
    return found.select(F.regexp_extract("path", r"(\d+)\.tif$", 1).cast("long").alias("raster"), "height", "width", "epsg", F.col("n").alias("north"), F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), placed.alias("placed"))


GRID = 64
#: The corners of a star's rays, in quarters of its radius.
RAYS = ((8, 0), (6, 5), (0, 8), (-5, 6), (-8, 0), (-6, -5), (0, -8), (5, -6))


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(aoi_index, id, rings) of parts as stars of eight rays in their area's grid; every third has a hole, every fiftieth is large and leaves the grid."""
    k = F.col("p_partkey")
    size, cx, cy = F.when(k % 50 == 0, 4.0).otherwise(1.0), k * 13 % GRID, k * 29 % GRID
    ring = lambda reach: F.array(*[F.array(cx + dx * size * reach(i), cy + dy * size * reach(i)) for i, (dx, dy) in enumerate(RAYS)])
    outer, hole = ring(lambda i: ((k * 7 + i * 5) % 4 + 1) / 4.0), ring(lambda i: F.lit(0.25))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select((k % 97).alias("aoi_index"), k.alias("id"), F.when(k % 3 == 0, F.array(outer, hole)).otherwise(F.array(outer)).alias("rings"))


def rasterize_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of varied shapes burned into the grid of their area by scanlines: pixels that any of them covers, and the sum of their places."""
    burned = R.merged_spans(R.ring_spans(stars(spark, sf_dir), "aoi_index", "id", "rings", GRID, GRID, 16))
    n = (F.col("end") - F.col("begin")).cast("long")
    places = n * F.col("row") * GRID + n * (F.col("begin") + F.col("end") - 1) / 2
    return burned.groupBy(F.col("area").alias("aoi_index")).agg(F.sum(n).alias("burned"), F.sum(places).cast("long").alias("index_sum"))


def sample_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample row for each chip: image facts, mask and validity counts, and the ways of its area (left join)."""
    ways = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy((F.col("p_partkey") % 700).alias("aoi_index")).agg(F.count(F.lit(1)).alias("n_ways"))
    count = lambda name: F.aggregate("px", F.lit(0).cast("long"), lambda a, x: a + x[name])
    chip = H.chips(spark, sf_dir).select(F.col("vec_id").alias("aoi_index"), "region", F.concat(F.lit("asset-"), F.col("vec_id")).alias("asset_id"), F.lit(H.SIDE).alias("height"), F.lit(H.SIDE).alias("width"), count("target").alias("mask_pixels"), count("valid").alias("valid_pixels"))
    return chip.join(ways, "aoi_index", "left").withColumn("n_ways", F.coalesce("n_ways", F.lit(0)))


QUERIES = {
    f.__name__: f
    for f in (connected_components, small_component_filter, component_keep_semi_join, component_outline_stats, sweep_with_area_filter, binary_erosion, d4_augment, augmented_samples, bilinear_reproject, area_reproject, pad_and_collate, confusion_classes, inference_report, channel_normalise, valid_pixel_fraction, foreground_pixels, softmax_probability, rasterize_polygons, rasterize_rings, seam_components, windowed_read, tiff_windows, sample_projection)
}


def _labelled(mask: str, keys: str = "vec_id", side: int = 8) -> str:
    on = " AND ".join(f"r.{k} = m.{k}" for k in keys.split(", "))
    ks = ", ".join(f"r.{k}" for k in keys.split(", "))
    return f"""m AS ({mask}), r AS (
  SELECT {keys}, i, i AS root FROM m
  UNION SELECT {ks.replace('r.', 'r.')}, m.i, r.root FROM r JOIN m ON {on} AND ((abs(r.i - m.i) = {side}) OR (abs(r.i - m.i) = 1 AND r.i // {side} = m.i // {side})) AND m.i > r.root
), lab AS (SELECT {keys}, i, min(root) AS component FROM r GROUP BY {keys}, i), sz AS (SELECT {keys}, component, count(*) AS n FROM lab GROUP BY {keys}, component)"""


_MASK = f"WITH RECURSIVE {H.SQL}, {_labelled('SELECT vec_id, i FROM px WHERE p >= 0.6')}"
_FLIP = "CASE WHEN vec_id % 2 = 1 THEN 7 - {c} ELSE {c} END"
_RAYS = "r AS (SELECT unnest([" + ", ".join(str(dx) for dx, _ in RAYS) + "]) AS dx, unnest([" + ", ".join(str(dy) for _, dy in RAYS) + "]) AS dy, unnest(range(8)) AS i)"
SQL = {
    "tiff_windows": f"""WITH {H.SQL}, a AS (
  SELECT vec_id // 16 AS raster, vec_id % 16 // 4 * 8 + i // 8 - 3 AS r, vec_id % 4 * 8 + i % 8 - 5 AS c, floor(p * 255)::BIGINT AS b FROM px
), k AS (SELECT DISTINCT raster FROM a)
SELECT k.raster, 19 AS height, 26 AS width, 3857 AS epsg, 32::DOUBLE AS north, coalesce(sum(b), 0)::BIGINT AS total, coalesce(sum(b * (r * 26 + c + 1)), 0)::BIGINT AS placed
FROM k LEFT JOIN a ON k.raster = a.raster AND r >= 0 AND r < 19 AND c >= 0 AND c < 26 GROUP BY k.raster""",
    "windowed_read": f"""WITH {H.SQL}, a AS (
  SELECT vec_id // 16 AS raster, (vec_id % 16 // 4 * 8 + i // 8) // 2 AS r, (vec_id % 4 * 8 + i % 8) // 2 AS c, p FROM px WHERE valid = 1
), l AS (SELECT raster, r, c, avg(p) AS v FROM a WHERE r >= 1 AND r < 11 AND c >= 2 AND c < 16 GROUP BY ALL
), met AS (SELECT DISTINCT vec_id // 16 AS raster FROM px WHERE vec_id % 16 // 4 * 8 <= 21)
SELECT met.raster, 1 AS level, 10 AS height, 14 AS width, count(v)::BIGINT AS known, round(coalesce(sum(v), 0), 6) AS total, round(coalesce(sum(v * ((r - 1) * 14 + c - 2 + 1)), 0), 6) AS placed FROM met LEFT JOIN l ON met.raster = l.raster GROUP BY met.raster""",
    "seam_components": f"""WITH RECURSIVE {H.SQL}, {_labelled("SELECT vec_id // 16 AS vec_id, (vec_id % 16 // 4 * 8 + i // 8) * 32 + vec_id % 4 * 8 + i % 8 AS i FROM px WHERE p >= 0.55", side=32)}
SELECT vec_id AS raster, (component // 32)::INT AS row, (component % 32)::INT AS col, n::BIGINT AS size FROM sz""",
    "rasterize_rings": f"""WITH {_RAYS}, p AS (
  SELECT p_partkey AS k, CASE WHEN p_partkey % 50 = 0 THEN 4::DOUBLE ELSE 1::DOUBLE END AS size, p_partkey * 13 % {GRID} AS cx, p_partkey * 29 % {GRID} AS cy FROM part
), c AS (
  SELECT k, 0 AS ring, i, cx + dx * size * (((k * 7 + i * 5) % 4 + 1) / 4::DOUBLE) AS x, cy + dy * size * (((k * 7 + i * 5) % 4 + 1) / 4::DOUBLE) AS y FROM p, r
  UNION ALL SELECT k, 1, i, cx + dx * size * 0.25::DOUBLE, cy + dy * size * 0.25::DOUBLE FROM p, r WHERE k % 3 = 0
), s AS (SELECT a.k, a.x, a.y, b.x AS x2, b.y AS y2 FROM c a JOIN c b ON a.k = b.k AND a.ring = b.ring AND b.i = (a.i + 1) % 8
), u AS (SELECT k, least(y, y2) AS y, greatest(y, y2) AS y2, CASE WHEN y <= y2 THEN x ELSE x2 END AS x, CASE WHEN y <= y2 THEN x2 ELSE x END AS x2 FROM s
), w AS (SELECT *, unnest(range(greatest(0, ceil(y - 0.5))::BIGINT, least({GRID}, ceil(y2 - 0.5))::BIGINT)) AS row FROM u
), z AS (SELECT k, row, (x2 - x) * (row + 0.5::DOUBLE - y) / (y2 - y) + x AS cut FROM w
), g AS (SELECT k, row, unnest(range(greatest(0, floor(min(cut)) - 1)::BIGINT, least({GRID}, ceil(max(cut)) + 1)::BIGINT)) AS c FROM z GROUP BY k, row
), f AS (SELECT DISTINCT g.k % 97 AS aoi_index, g.row, g.c FROM g JOIN z ON g.k = z.k AND g.row = z.row GROUP BY g.k, g.row, g.c HAVING count(*) FILTER (cut <= g.c + 0.5::DOUBLE) % 2 = 1)
SELECT aoi_index, count(*)::BIGINT AS burned, sum(row * {GRID} + c)::BIGINT AS index_sum FROM f GROUP BY aoi_index""",
    "connected_components": f"{_MASK} SELECT vec_id, component, n::BIGINT AS size FROM sz",
    "small_component_filter": f"""{_MASK}, k AS (SELECT lab.vec_id, lab.i FROM lab JOIN sz USING (vec_id, component) WHERE n * 4 >= 10)
SELECT px.vec_id, string_agg(CASE WHEN k.i IS NULL THEN '0' ELSE '1' END, '' ORDER BY px.i) AS kept FROM px LEFT JOIN k ON px.vec_id = k.vec_id AND px.i = k.i GROUP BY px.vec_id""",
    "component_keep_semi_join": f"{_MASK} SELECT vec_id, i, component FROM lab SEMI JOIN (SELECT * FROM sz WHERE n * 4 >= 10) s USING (vec_id, component)",
    "component_outline_stats": f"""{_MASK}, e AS (
  SELECT a.vec_id, a.component, a.i, 4 - count(b.i) AS edges FROM lab a LEFT JOIN lab b ON a.vec_id = b.vec_id AND a.component = b.component AND (abs(a.i - b.i) = 8 OR (abs(a.i - b.i) = 1 AND a.i // 8 = b.i // 8)) GROUP BY ALL
) SELECT vec_id, component, count(*)::BIGINT AS pixels, min(i // 8)::INT AS min_row, max(i // 8)::INT AS max_row, min(i % 8)::INT AS min_col, max(i % 8)::INT AS max_col, sum(edges)::BIGINT AS outline FROM e GROUP BY vec_id, component HAVING count(*) * 4 <= 60""",
    "sweep_with_area_filter": f"""WITH RECURSIVE {H.SQL}, g AS (SELECT unnest(range(17))::INT AS o, unnest([{", ".join(f"{t}::DOUBLE" for t in C.THRESHOLDS)}]) AS t),
{_labelled("SELECT vec_id, o, i FROM px, g WHERE p >= t", "vec_id, o")}, f AS (SELECT unnest(range(5))::INT AS k, unnest([0, 5, 10, 25, 50])::DOUBLE AS area), l AS (
  SELECT lab.vec_id, lab.o, lab.i, n FROM lab JOIN sz USING (vec_id, o, component)
), cc AS (
  SELECT px.vec_id, g.o, t, f.k, area, (count(*) FILTER (valid = 1 AND n * 4 >= area AND target = 1))::BIGINT AS tp, (count(*) FILTER (valid = 1 AND n * 4 >= area AND target = 0))::BIGINT AS fp,
    (count(*) FILTER (valid = 1 AND (n IS NULL OR n * 4 < area) AND target = 1))::BIGINT AS fn
  FROM px CROSS JOIN g CROSS JOIN f LEFT JOIN l ON px.vec_id = l.vec_id AND px.i = l.i AND g.o = l.o GROUP BY ALL
), s AS (SELECT *, {H.IOU} AS iou, {H.F1} AS f1 FROM cc)
SELECT vec_id, t AS best_threshold, area AS best_area_filter_m2, iou AS best_iou, f1 AS best_f1 FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY iou DESC, o * 5 + k) = 1""",
    "binary_erosion": f"""WITH {H.SQL}, e AS (
  SELECT a.vec_id, a.i, count(b.i) = 9 AS whole FROM px a LEFT JOIN px b ON a.vec_id = b.vec_id AND b.p >= 0.3 AND abs(a.i // 8 - b.i // 8) <= 1 AND abs(a.i % 8 - b.i % 8) <= 1 GROUP BY ALL
) SELECT vec_id, string_agg(CASE WHEN whole THEN '1' ELSE '0' END, '' ORDER BY i) AS eroded FROM e GROUP BY vec_id""",
    "d4_augment": f"""WITH {H.SQL}, j AS (
  SELECT vec_id, o::INT AS o, o // 8 AS r, o % 8 AS c, (vec_id // 4) % 4 AS k FROM (SELECT vec_id, unnest(range(64)) AS o FROM c)
), s AS (
  SELECT *, CASE k WHEN 1 THEN c WHEN 2 THEN 7 - r WHEN 3 THEN 7 - c ELSE r END AS row1, CASE k WHEN 1 THEN 7 - r WHEN 2 THEN 7 - c WHEN 3 THEN r ELSE c END AS col1 FROM j
), q AS (
  SELECT vec_id, o, (CASE WHEN (vec_id // 2) % 2 = 1 THEN 7 - row1 ELSE row1 END) * 8 + {_FLIP.format(c='col1')} AS i FROM s
) SELECT q.vec_id, string_agg(px.target::VARCHAR, '' ORDER BY o) AS turned FROM q JOIN px ON q.vec_id = px.vec_id AND q.i = px.i GROUP BY q.vec_id""",
    "augmented_samples": f"""WITH {H.SQL}, j AS (
  SELECT vec_id, o::INT AS o, o // 16 AS r, o % 16 AS c, (vec_id // 4) % 4 >= 2 AS half FROM (SELECT vec_id, unnest(range(64)) AS o FROM c)
), s AS (SELECT vec_id, o, CASE WHEN half THEN 3 - r ELSE r END AS r, CASE WHEN half THEN 15 - c ELSE c END AS c FROM j
), q AS (SELECT vec_id, o, (CASE WHEN (vec_id // 2) % 2 = 1 THEN 3 - r ELSE r END) * 16 + CASE WHEN vec_id % 2 = 1 THEN 15 - c ELSE c END AS i FROM s)
SELECT q.vec_id, string_agg(px.target::VARCHAR, '' ORDER BY o) AS mask, string_agg(px.valid::VARCHAR, '' ORDER BY o) AS valid, round(sum(p) FILTER (o < 16), 6) AS first_row FROM q JOIN px ON q.vec_id = px.vec_id AND q.i = px.i GROUP BY q.vec_id""",
    "bilinear_reproject": f"""WITH {H.SQL}, g AS (SELECT o::INT AS o, (o // 5) * 1.75::DOUBLE - 0.5::DOUBLE AS y, (o % 5) * 1.75::DOUBLE - 0.5::DOUBLE AS x FROM (SELECT unnest(range(25)) AS o)), k AS (
  SELECT o, (floor(y) + dy)::INT AS r, (floor(x) + dx)::INT AS c, (1 - abs(y - floor(y) - dy)) * (1 - abs(x - floor(x) - dx)) AS weight, y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7 AS inside FROM g, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx)
) SELECT vec_id, o, round(coalesce(sum(p * weight) FILTER (inside), 0), 9) AS value FROM k LEFT JOIN px ON px.i = greatest(least(r, 7), 0) * 8 + greatest(least(c, 7), 0) GROUP BY vec_id, o""",
    "area_reproject": f"""WITH {H.SQL}, b AS (
  SELECT vec_id, vec_id % 300 - 150::DOUBLE AS w, vec_id * 7 % 120 - 60::DOUBLE AS s, vec_id % 300 - 150::DOUBLE + 1 + vec_id % 4 * 0.5::DOUBLE AS e, vec_id * 7 % 120 - 60::DOUBLE + 1 + vec_id % 3 * 0.75::DOUBLE AS n FROM c
), m AS (SELECT *, radians(w) AS x0, radians(e) AS x1, ln(tan(pi() / 4 + radians(s) / 2)) AS y0, ln(tan(pi() / 4 + radians(n) / 2)) AS y1 FROM b
), z AS (SELECT *, (x1 - x0) / (y1 - y0) AS ratio FROM m
), d AS (SELECT *, CASE WHEN ratio >= 1 THEN 6 ELSE greatest(1, round_even(6 * ratio, 0)::INT) END AS to_w, CASE WHEN ratio >= 1 THEN greatest(1, round_even(6 / ratio, 0)::INT) ELSE 6 END AS to_h FROM z
), o AS (SELECT *, unnest(range(to_w * to_h))::INT AS o FROM d
), g AS (
  SELECT vec_id, to_w, to_h, o, (degrees(x0 + (o % to_w + 0.5::DOUBLE) * ((x1 - x0) / to_w)) - w) / (e - w) * 8 - 0.5::DOUBLE AS x,
    (n - degrees(2 * atan(exp(y1 - (o // to_w + 0.5::DOUBLE) * ((y1 - y0) / to_h))) - pi() / 2)) / (n - s) * 8 - 0.5::DOUBLE AS y FROM o
), k AS (
  SELECT *, (floor(y) + dy)::INT AS r, (floor(x) + dx)::INT AS q, (1 - abs(y - floor(y) - dy)) * (1 - abs(x - floor(x) - dx)) AS weight, y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7 AS inside FROM g, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx)
) SELECT k.vec_id, to_w, to_h, o, round(coalesce(sum(p * weight) FILTER (inside), 0), 6) AS value FROM k JOIN px ON px.vec_id = k.vec_id AND px.i = greatest(least(r, 7), 0) * 8 + greatest(least(q, 7), 0) GROUP BY ALL""",
    "pad_and_collate": f"""WITH {H.SQL}, s AS (SELECT vec_id, vec_id // 4 AS batch, (vec_id % 5 + 3)::INT AS h, (vec_id % 3 + 5)::INT AS w FROM c), b AS (SELECT batch, max(h) AS to_h, max(w) AS to_w FROM s GROUP BY batch)
SELECT s.vec_id, s.batch, to_h, to_w, any_value(h * w) AS valid_pixels, any_value(to_h * to_w) AS pixels, any_value((32 - to_h % 32) % 32) AS pad_h, round(sum(p), 6) AS total
FROM s JOIN b USING (batch) JOIN px ON s.vec_id = px.vec_id AND px.i // 8 < h AND px.i % 8 < w GROUP BY s.vec_id, s.batch, to_h, to_w""",
    "confusion_classes": f"""WITH {H.SQL} SELECT region, CASE WHEN valid = 0 THEN 'invalid' WHEN p >= 0.5 AND target = 1 THEN 'tp' WHEN p >= 0.5 THEN 'fp' WHEN target = 1 THEN 'fn' ELSE 'tn' END AS class, count(*)::BIGINT AS n FROM px GROUP BY ALL""",
    "inference_report": f"""{_MASK}, k AS (SELECT lab.vec_id, lab.i, component FROM lab JOIN sz USING (vec_id, component) WHERE n * 4 >= 10), a AS (
  SELECT px.vec_id, count(DISTINCT component)::BIGINT AS pred_polys, count(*) FILTER (valid = 1 AND target = 1)::BIGINT AS gt_pixels, count(*) FILTER (valid = 1 AND k.i IS NOT NULL)::BIGINT AS pred_pixels, count(*) FILTER (valid = 1)::BIGINT AS valid_pixels, count(*)::BIGINT AS total_pixels,
    count(*) FILTER (valid = 1 AND k.i IS NOT NULL AND target = 1)::BIGINT AS tp FROM px LEFT JOIN k ON px.vec_id = k.vec_id AND px.i = k.i GROUP BY px.vec_id
), b AS (SELECT *, pred_pixels - tp AS fp, gt_pixels - tp AS fn FROM a)
SELECT vec_id, pred_polys, gt_pixels, pred_pixels, valid_pixels, total_pixels, tp, valid_pixels / total_pixels::DOUBLE AS valid_fraction, {H.IOU} AS iou, {H.PANEL_F1} AS f1 FROM b""",
    "channel_normalise": f"""WITH {H.SQL}, b AS (SELECT vec_id, [floor(x * 255)::INT FOR x IN p] AS b FROM t), e AS (SELECT vec_id, b, unnest(range(22))::INT AS i FROM b), z AS (
  SELECT vec_id, i, b[i + 1] / 255::DOUBLE AS r, CASE WHEN vec_id % 5 = 0 THEN 0::DOUBLE ELSE b[i + 22] / 255::DOUBLE END AS g, CASE WHEN vec_id % 5 = 0 THEN 0::DOUBLE ELSE b[i + 43] / 255::DOUBLE END AS b FROM e
) SELECT *, r + g + b > 0 AS valid FROM z""",
    "valid_pixel_fraction": f"""WITH {H.SQL}, v AS (SELECT vec_id, target, CASE WHEN vec_id % 7 = 0 THEN 1 ELSE valid END AS v FROM px)
SELECT vec_id, sum(v) / count(*)::DOUBLE AS valid_fraction, coalesce(sum(v * target) / nullif(sum(v), 0)::DOUBLE, 0) AS positive_fraction FROM v GROUP BY vec_id""",
    "foreground_pixels": f"WITH {H.SQL} SELECT vec_id, count(*) FILTER (p >= 0.9) > 0 AS has_foreground, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (p >= 0.9), '') AS foreground FROM px GROUP BY vec_id",
    "softmax_probability": "SELECT vec_id, i::INT AS i, round(1::DOUBLE / (1::DOUBLE + exp(e[i + 1]::DOUBLE - e[i + 33]::DOUBLE)), 9) AS p FROM (SELECT vec_id, embedding AS e, unnest(range(32)) AS i FROM embeddings)",
    "rasterize_polygons": """WITH b AS (SELECT p_partkey % 97 AS aoi, p_partkey % 6 AS x0, p_size % 5 AS y0, p_size % 3 + 1 AS d FROM part), g AS (SELECT DISTINCT aoi, i FROM b, (SELECT unnest(range(64)) AS i)
  WHERE i % 8 + 0.5 > x0 AND i % 8 + 0.5 < x0 + d + 1 AND i // 8 + 0.5 > y0 AND i // 8 + 0.5 < y0 + d)
SELECT a.aoi_index, count(i)::BIGINT AS burned, coalesce(sum(i), 0)::BIGINT AS index_sum FROM (SELECT unnest(range(100)) AS aoi_index) a LEFT JOIN g ON a.aoi_index = g.aoi GROUP BY a.aoi_index""",
    "sample_projection": f"""WITH {H.SQL}, w AS (SELECT p_partkey % 700 AS aoi, count(*) AS n FROM part GROUP BY 1)
SELECT vec_id AS aoi_index, any_value(region) AS region, 'asset-' || vec_id AS asset_id, 8 AS height, 8 AS width, sum(target)::BIGINT AS mask_pixels, sum(valid)::BIGINT AS valid_pixels, coalesce(any_value(w.n), 0)::BIGINT AS n_ways
FROM px LEFT JOIN w ON px.vec_id = w.aoi GROUP BY vec_id""",
}
