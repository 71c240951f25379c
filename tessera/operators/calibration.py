"""Threshold sweeps over probability maps and their summaries.

A map is an array of pixels in one row, so a sweep is a projection: no pixel is shuffled, and the
thresholds multiply nothing but a few counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import metrics as M
from tessera.operators import raster as R

THRESHOLDS = tuple(round(0.1 + 0.05 * i, 2) for i in range(17))
AREA_FILTERS_M2 = (0.0, 5.0, 10.0, 25.0, 50.0)


def counts(px: Column, predicted) -> list[Column]:
    """tp, fp and fn over the valid pixels of an array; ``predicted`` maps a pixel to a boolean."""
    n = lambda test: F.size(F.filter(px, lambda x: (x["valid"] == 1) & test(x))).cast("long")
    return [
        n(lambda x: predicted(x) & (x["target"] == 1)).alias("tp"),
        n(lambda x: predicted(x) & (x["target"] == 0)).alias("fp"),
        n(lambda x: ~predicted(x) & (x["target"] == 1)).alias("fn"),
    ]


def confusion(chips: DataFrame, predicted) -> DataFrame:
    """(vec_id, region, tp, fp, fn, iou, f1) of each chip."""
    return scored(chips.select("vec_id", "region", *counts(F.col("px"), predicted)))


def scored(counted: DataFrame) -> DataFrame:
    c = [F.col(x) for x in ("tp", "fp", "fn")]
    return counted.withColumns({"iou": M.iou(*c), "f1": M.f1(*c)})


def sweep(chips: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """A row of counts and metrics for each chip and threshold, with the threshold's ordinal; thresholds rise."""
    field = lambda name: F.transform("px", lambda x: x[name])
    each = chips.select("vec_id", "region", F.explode(R.threshold_counts(field("p"), field("target"), field("valid"), thresholds)).alias("s"))
    threshold = F.element_at(F.array(*[F.lit(t) for t in thresholds]), F.col("s.ordinal") + 1)
    return scored(each.select("vec_id", "region", "s.ordinal", threshold.alias("threshold"), "s.tp", "s.fp", "s.fn"))


def best_thresholds(swept: DataFrame) -> DataFrame:
    """The first threshold of the best IoU of each chip, with its F1."""
    best = M.first_best(F.col("iou"), F.col("ordinal"), F.col("threshold").alias("best_threshold"), F.col("iou").alias("best_iou"), F.col("f1").alias("best_f1"))
    return swept.groupBy("vec_id", "region").agg(best.alias("b")).select("vec_id", "region", "b.*")


def sweep_areas(chips: DataFrame, side: int, key: str, thresholds: tuple[float, ...] = THRESHOLDS, areas: tuple[float, ...] = AREA_FILTERS_M2) -> DataFrame:
    """(key, ordinal, threshold, area_filter_m2, tp, fp, fn, iou, f1) of chips (key, px, pixel_m2) for every threshold and area filter.

    Components are labelled and counted once for each threshold; filters are sums over them. A filter of 0
    keeps all. Ordinals go by threshold, then filter.
    """
    field = lambda name: F.transform("px", lambda x: x[name])
    found = R.component_counts(field("p"), field("target"), field("valid"), thresholds, side)
    each = chips.select(key, "pixel_m2", F.explode(found).alias("f")).select(key, "pixel_m2", "f.*")
    each = each.withColumn("a", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(area).alias("area")) for k, area in enumerate(areas)])))
    total = lambda name: F.aggregate("components", F.lit(0).cast("long"), lambda s, c: s + F.when(c["size"] * F.col("pixel_m2") >= F.col("a.area"), c[name]).otherwise(0))
    threshold = F.element_at(F.array(*[F.lit(t) for t in thresholds]), F.col("ordinal") + 1)
    counted = each.select(key, (F.col("ordinal") * len(areas) + F.col("a.k")).alias("ordinal"), threshold.alias("threshold"), F.col("a.area").alias("area_filter_m2"), total("tp").alias("tp"), total("fp").alias("fp"), "positives")
    return scored(counted.withColumn("fn", F.col("positives") - F.col("tp")).drop("positives"))


def best_of_grid(grid: DataFrame, *keys: str) -> DataFrame:
    """(keys..., best_threshold, best_area_filter_m2, best_iou, best_f1): the first cell of the best IoU."""
    best = M.first_best(F.col("iou"), F.col("ordinal"), F.col("threshold").alias("best_threshold"), F.col("area_filter_m2").alias("best_area_filter_m2"), F.col("iou").alias("best_iou"), F.col("f1").alias("best_f1"))
    return grid.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def summary(metric: str) -> list[Column]:
    """n, mean, median, min, max and the quartiles by linear interpolation."""
    at = lambda q: F.round(F.percentile(metric, F.lit(q)), 9)
    return [F.count(F.lit(1)).alias("n"), F.round(F.avg(metric), 9).alias("mean"), at(0.5).alias("median"), F.min(metric).alias("min"), F.max(metric).alias("max"), at(0.25).alias("p25"), at(0.75).alias("p75")]


def by_region(rows: DataFrame, metric: str = "best_iou") -> DataFrame:
    """A summary of the chosen metric for each region; untagged rows are a region of their own, a missing metric is 0."""
    return rows.withColumn(metric, F.coalesce(F.col(metric), F.lit(0.0))).groupBy("region").agg(*summary(metric))
