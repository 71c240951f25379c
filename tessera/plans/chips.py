"""Image chips out of the ``embeddings`` table: 64 components are an 8 by 8 probability map.

The truth of a chip is the next chip of its label (the last one wraps round) at 0.5, pixel i of
chip v is valid unless 11 divides v + 3 i, and the label is the region; label 0 is untagged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.kernels import bound_batches

SIDE = 8
PIXELS = SIDE * SIDE


def chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, region, px): px holds a struct (i, p, target, valid) for each pixel."""
    bound_batches(spark)
    order = Window.partitionBy("label").orderBy("vec_id")  # over ids alone; pixels meet by the id of the next chip
    low, high = F.array_min("v"), F.array_max("v")
    p = F.transform("v", lambda x: F.when(high > low, (x - low) / F.when(high > low, high - low).otherwise(1.0)).otherwise(0.0))
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).select("vec_id", "label", p.alias("p"))
    follows = base.select("vec_id", F.coalesce(F.lead("vec_id").over(order), F.first("vec_id").over(order)).alias("next_id"))
    paired = base.join(follows, "vec_id").join(base.select(F.col("vec_id").alias("next_id"), F.col("p").alias("next")), "next_id")
    px = F.zip_with(
        F.arrays_zip(F.sequence(F.lit(0), F.lit(PIXELS - 1)).alias("i"), F.col("p")),
        "next",
        lambda a, b: F.struct(a["i"].alias("i"), a["p"].alias("p"), (b >= 0.5).cast("int").alias("target"), ((F.col("vec_id") + 3 * a["i"]) % 11 != 0).cast("int").alias("valid")),
    )
    region = F.when(F.col("label") == 0, "").otherwise(F.concat(F.lit("r"), F.col("label").cast("string")))
    return paired.select("vec_id", region.alias("region"), px.alias("px"))


def pixels(chip: DataFrame) -> DataFrame:
    return chip.select("vec_id", "region", F.explode("px").alias("x")).select("vec_id", "region", "x.*")


#: The same as common table expressions: px has a row for each pixel.
SQL = """c AS (
  SELECT vec_id, label, CASE WHEN label = 0 THEN '' ELSE 'r' || label END AS region, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings
), n AS (
  SELECT vec_id, label, region, CASE WHEN list_max(v) > list_min(v) THEN [(x - list_min(v)) / (list_max(v) - list_min(v)) FOR x IN v] ELSE [0::DOUBLE FOR x IN v] END AS p FROM c
), t AS (
  SELECT *, coalesce(lead(p) OVER w, first_value(p) OVER w) AS q FROM n WINDOW w AS (PARTITION BY label ORDER BY vec_id)
), px AS (
  SELECT vec_id, region, i::INT AS i, p, (q >= 0.5)::INT AS target, ((vec_id + 3 * i) % 11 <> 0)::INT AS valid
  FROM (SELECT vec_id, region, unnest(range(64)) AS i, unnest(p) AS p, unnest(q) AS q FROM t)
)"""
IOU = "CASE WHEN tp + fp + fn = 0 THEN 1::DOUBLE ELSE tp / (tp + fp + fn)::DOUBLE END"
PREC, REC = "CASE WHEN tp + fp = 0 THEN 0::DOUBLE ELSE tp / (tp + fp)::DOUBLE END", "CASE WHEN tp + fn = 0 THEN 0::DOUBLE ELSE tp / (tp + fn)::DOUBLE END"
PANEL_F1 = f"CASE WHEN tp = 0 THEN 0::DOUBLE ELSE 2::DOUBLE * ({PREC}) * ({REC}) / (({PREC}) + ({REC})) END"
F1 = f"CASE WHEN tp + fp + fn = 0 THEN 1::DOUBLE ELSE {PANEL_F1} END"
SUMMARY = """count(*)::BIGINT AS n, round(avg({m}), 9) AS mean, round(median({m}), 9) AS median, min({m}) AS min, max({m}) AS max,
  round(quantile_cont({m}, 0.25), 9) AS p25, round(quantile_cont({m}, 0.75), 9) AS p75"""
