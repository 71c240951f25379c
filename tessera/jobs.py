"""Jobs of a recipe: training, threshold sweeps, evaluation, inference and checks of its areas.

Chips of the areas are a table (aoi_index, px), px an array of structs (i, p, target, valid) of a
square image by rows. A run's folder keeps the training; jobs that come after it use its best
parameters, and without it take ``p`` as the probability, which they say.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.functions import metrics as M
from tessera.operators import aoi as A
from tessera.operators import calibration as C
from tessera.operators import geometry as G
from tessera.operators import raster as R
from tessera.operators import training
from tessera.sources import reports, sinks
from tessera.sources.recipes import Recipe


@dataclass
class Report:
    """What a job found, and the lines that tell it."""

    rows: DataFrame
    lines: list[str]


def areas(spark: SparkSession, recipe: Recipe) -> DataFrame:
    """The areas of a recipe with their split."""
    return A.split(recipe.areas(spark).withColumn("recipe", F.lit(recipe.name)), "recipe", recipe.val_regions).drop("recipe")


def chips_of(spark: SparkSession, recipe: Recipe, chips: DataFrame, which: str) -> DataFrame:
    """The chips of the recipe's areas that are ``train`` or ``val``, or ``all``; without validation areas val is all of them."""
    own = areas(spark, recipe)
    if which == "val" and own.where("split = 'val'").isEmpty():
        which = "all"
    return chips.select("aoi_index", "px").join(own if which == "all" else own.where(F.col("split") == which), "aoi_index")


def side_of(chips: DataFrame) -> int:
    """The side of the chips, which must be squares of one size."""
    found = chips.agg(F.min(F.size("px")).alias("least"), F.max(F.size("px")).alias("most")).first()
    side = round((found["least"] or 0) ** 0.5)
    if not found["least"] or found["least"] != found["most"] or side * side != found["least"]:
        raise ValueError("chips must be squares of one size")
    return side


def with_model(chips: DataFrame, side: int, run_dir: str) -> tuple[DataFrame, str]:
    """Chips whose ``p`` is the probability by the run's best parameters, and a line that says what was loaded."""
    state = training.load(chips.sparkSession, run_dir)
    if state is None or state.best_weights is None:
        return chips, f"WARNING: {run_dir} has no training; taking chips as probabilities"
    return training.probabilities(chips, state.best_weights, side), f"loaded epoch {state.best['epoch']} of {run_dir}"


def pixel_m2(side: int) -> Column:
    """The true area of a pixel of an area's chip in Mercator."""
    width, height = geo.mercator_x(F.col("e")) - geo.mercator_x(F.col("w")), geo.mercator_y(F.col("n")) - geo.mercator_y(F.col("s"))
    return geo.pixel_area_m2(width / side, -height / side, F.lit("EPSG:3857"), F.col("s"), F.col("n"))


def _told(lines: DataFrame, *order: str) -> list[str]:
    """The lines of a report, of which a recipe has a few for each area."""
    return [r["line"] for r in lines.orderBy(*order).select("line").collect()]


def train(spark: SparkSession, recipe: Recipe, chips: DataFrame, run_dir: str, settings: training.Settings | None = None) -> Report:
    """Trains on the train areas with the recipe's settings; validation areas choose the best epoch."""
    own = chips_of(spark, recipe, chips, "train")
    split = areas(spark, recipe)
    val = chips.join(split.where("split = 'val'"), "aoi_index")
    t = recipe.training
    settings = settings or training.Settings(epochs=t.epochs, batch=t.batch, rate=t.learning_rate, seed=t.seed)
    state = training.train(own, None if val.isEmpty() else val, side_of(chips), run_dir, settings, "aoi_index")
    rows = training.history(spark, state)
    sinks.write_json(rows, f"{run_dir}/history")
    best = rows.where("best").select(F.col("epoch").alias("best_epoch"), F.lit(state.best["val_iou"]).alias("best_val_iou"))
    return Report(rows, [f"artifacts: {run_dir}/", *_told(reports.epoch_lines(rows), "epoch"), *_told(reports.best_epoch_lines(best), "line")])


def sweep(spark: SparkSession, recipe: Recipe, chips: DataFrame, run_dir: str, on_train: bool = False) -> Report:
    """The best threshold and area filter of each area, written with the whole grid; by region where there is any."""
    own = chips_of(spark, recipe, chips, "train" if on_train else "val")
    side = side_of(own)
    scored, loaded = with_model(own, side, run_dir)
    grid = C.sweep_areas(scored.withColumn("pixel_m2", pixel_m2(side)), side, "aoi_index").join(own.select("aoi_index", "region"), "aoi_index")
    best = C.best_of_grid(grid, "aoi_index", "region")
    cells = F.sort_array(F.collect_list(F.struct("ordinal", "threshold", "area_filter_m2", "iou", "f1")))
    path = f"{run_dir}/thresholds{'_train' if on_train else ''}"
    sinks.write_json(best.join(grid.groupBy("aoi_index").agg(cells.alias("sweep")), "aoi_index"), path)
    rows = spark.read.schema(best.schema).json(path)
    regions = reports.region_lines(C.by_region(rows), "mean", "median", "min", "p25", "p75")
    told = _told(regions, "region")
    return Report(rows, [loaded, f"wrote {path}", *_told(reports.sweep_lines(rows), "aoi_index"), *(["per-region (best_iou):", *told] if told else [])])


def evaluate(spark: SparkSession, recipe: Recipe, chips: DataFrame, run_dir: str) -> Report:
    """Mean IoU and F1 over the validation areas, and by region where there is any."""
    own = chips_of(spark, recipe, chips, "val")
    scored, loaded = with_model(own, side_of(own), run_dir)
    rows = C.confusion(scored.withColumnRenamed("aoi_index", "vec_id"), lambda x: M.class_one(1.0 - x["p"], x["p"]))
    mean = rows.agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"mean_{m}") for m in ("iou", "f1")])
    by = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.avg("iou").alias("mean_iou"), F.median("iou").alias("median_iou"), F.min("iou").alias("min_iou"), F.avg("f1").alias("mean_f1"))
    told = _told(reports.region_lines(by, "mean_iou", "median_iou", "min_iou", "mean_f1"), "region")
    return Report(rows.withColumnRenamed("vec_id", "aoi_index"), [loaded, *_told(reports.eval_lines(mean), "ord"), *(["per-region (argmax):", *told] if told else [])])


def infer(spark: SparkSession, recipe: Recipe, chips: DataFrame, run_dir: str, area: int, threshold: float = 0.5, area_filter_m2: float = 0.0, every: bool = False) -> Report:
    """The inference of one area, by its place among the validation areas (``every``: among all): metadata, and polygons in degrees as GeoJSON."""
    own = chips_of(spark, recipe, chips, "all" if every else "val")
    pool = [r["aoi_index"] for r in own.select("aoi_index").distinct().orderBy("aoi_index").collect()]
    if not 0 <= area < len(pool):
        raise IndexError(f"area {area} of {len(pool)}")
    one = own.where(F.col("aoi_index") == pool[area])
    side = side_of(one)
    scored, loaded = with_model(one, side, run_dir)
    label = R.labels(F.transform("px", lambda x: M.at_least(x["p"], threshold).cast("int")), side)
    made = scored.withColumn("pixel_area_m2", pixel_m2(side)).withColumn("label", label).withColumn("sizes", R.sizes(F.col("label"))).withColumn("shapes", G.polygons(F.col("label"), side))
    every_size = (F.lit(area_filter_m2) <= 0) | (F.col("pixel_area_m2") <= 0)
    kept = F.transform(F.filter("sizes", lambda s: every_size | (s["size"] * F.col("pixel_area_m2") >= area_filter_m2)), lambda s: s["component"])
    made = made.withColumn("kept", kept).withColumn("shapes", F.filter("shapes", lambda s: F.array_contains("kept", s["component"]))).cache()
    z = F.zip_with("px", "label", lambda x, k: F.struct(F.array_contains("kept", k).alias("y"), (x["target"] == 1).alias("t"), (x["valid"] == 1).alias("v")))
    n = lambda test: F.size(F.filter("z", test)).cast("long")
    tp, fp, fn = n(lambda x: x["y"] & x["t"] & x["v"]), n(lambda x: x["y"] & ~x["t"] & x["v"]), n(lambda x: ~x["y"] & x["t"] & x["v"])
    valid, total = n(lambda x: x["v"]), F.size("px").cast("long")
    facts = made.withColumn("z", z).withColumns(
        {"iou": M.iou(tp, fp, fn), "f1": M.f1(tp, fp, fn), "n_pred_polys": F.size("shapes").cast("long"), "n_gt_pixels": n(lambda x: x["t"]), "n_pred_pixels": n(lambda x: x["y"]), "n_valid_pixels": valid, "n_total_pixels": total}
    )
    facts = facts.withColumns({"valid_fraction": valid / total, "threshold": F.lit(float(threshold)), "area_filter_m2": F.lit(float(area_filter_m2))})
    out = f"{run_dir}/infer/aoi_{area}"
    sinks.write_json(reports.metadata(facts).select(F.col("metadata")), f"{out}/metadata")
    x0, y0 = geo.mercator_x(F.col("w")), geo.mercator_y(F.col("n"))
    dx, dy = (geo.mercator_x(F.col("e")) - x0) / side, (y0 - geo.mercator_y(F.col("s"))) / side
    # rings of GeoJSON end where they begin
    ring = lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.array(geo.lon_of(x0 + p[0] * dx), geo.lat_of(y0 - p[1] * dy)))
    polygons = F.transform("shapes", lambda s: F.concat(F.array(ring(s["shell"])), F.transform(s["holes"], ring)))
    text = F.concat(F.lit('{"type":"Feature","geometry":{"type":"Polygon","coordinates":'), F.to_json("rings"), F.lit('},"properties":{}}'))
    sinks.write_geojson(made.select(F.explode(polygons).alias("rings")).select(text.alias("feature")), f"{out}/prediction")
    return Report(facts.drop("z", "px", "label", "sizes", "shapes", "kept"), [loaded, *_told(reports.inference_lines(facts), "ord"), f"  artifacts: {out}/"])


def check(spark: SparkSession, recipe: Recipe, chips: DataFrame, min_count: int = 10, min_fraction: float = 0.03, min_valid: float = A.MIN_VALID_FRACTION) -> Report:
    """The checks of a recipe's areas from their chips, one JSON object each; areas without a chip fail as not fetched."""
    side = side_of(chips)
    own = areas(spark, recipe).join(chips.select("aoi_index", "px"), "aoi_index", "left")
    target = F.transform("px", lambda x: (x["target"] == 1).cast("int"))
    count = lambda test: F.size(F.filter("px", test))
    valid = count(lambda x: x["valid"] == 1)
    facts = own.select(
        "aoi_index", "w", "s", "e", "n", F.when(F.col("px").isNull(), "no chip").alias("fetch_error"),
        F.coalesce(valid / F.size("px"), F.lit(0.0)).alias("valid_fraction"), F.coalesce(F.size(R.sizes(R.labels(target, side))), F.lit(0)).alias("n_polygons"),
        F.when(valid > 0, count(lambda x: (x["valid"] == 1) & (x["target"] == 1)) / F.greatest(valid, F.lit(1))).otherwise(0.0).alias("pixel_fraction"),
        F.lit(min_count).alias("min_count"), F.lit(min_fraction).alias("min_fraction"), F.lit(min_valid).alias("min_valid"),
    )
    rows = A.check(facts)
    told = F.struct(F.array("w", "s", "e", "n").alias("bbox"), "area_km2", "valid_fraction", F.col("n_polygons").alias("polygon_count"), "pixel_fraction", F.col("density").alias("polygon_density_per_km2"), "hard_pass", "reasons", "warnings", "soft", "quality")
    return Report(rows, _told(rows.select("aoi_index", F.to_json(told, {"ignoreNullFields": "false"}).alias("line")), "aoi_index"))
