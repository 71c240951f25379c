"""Queries on areas of interest, whose catalogue is customers with their nation and region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.operators import aoi as A

#: Thresholds of each feature: polygons, pixel share, erosion in pixels, tile layer.
FEATURES = {"building": (30, 0.0, 1, "building"), "park": (3, 0.05, 0, "park"), "parking": (2, 0.02, 0, "parking"), "road": (10, 0.03, 0, "road")}
#: Features that tiles serve, and the layer of each.
TILE_LAYERS = {"buildings": "building", "roads": "road", "parkings": "parking", "parks": "park"}
VAL_REGIONS = ("ASIA",)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nation = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    k = F.col("c_custkey")
    w, s = (k % 40) * 0.001 + 130, ((k * 3) % 53) * 0.001 + 35
    return (
        read("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(k.alias("aoi_index"), F.col("c_nationkey").alias("recipe"), F.col("r_name").alias("region"), F.when(k % 7 == 0, "").otherwise(F.col("c_mktsegment")).alias("phenotype"), (k % 5 == 0).alias("holdout"), w.alias("w"), s.alias("s"), (w + 0.01).alias("e"), (s + 0.01).alias("n"))
    )


def aoi_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.split(catalogue(spark, sf_dir), "recipe", VAL_REGIONS).select("aoi_index", "recipe", "split")


def implicit_last_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.split(catalogue(spark, sf_dir).withColumn("holdout", F.lit(False)), "recipe").where("split = 'val'").select("recipe", "aoi_index")


def has_explicit_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    explicit = A.explicit_val(F.col("holdout"), F.col("region"), VAL_REGIONS)
    return catalogue(spark, sf_dir).groupBy("recipe").agg(F.coalesce(F.bool_or(explicit), F.lit(False)).alias("has_val"))


def region_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("aoi_index") % 3 != 0, F.nullif(F.col("region"), F.lit("")))
    return catalogue(spark, sf_dir).groupBy("phenotype").agg(F.array_join(F.array_sort(F.collect_set(named)), ",").alias("regions"))


def phenotype_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.nullif(F.col("phenotype"), F.lit(""))
    rows = catalogue(spark, sf_dir).groupBy("recipe").agg(F.array_sort(F.collect_set(kind)).alias("kinds"), F.bool_or(F.col("phenotype") == "").alias("untagged"))
    n = F.size("kinds")
    return rows.select("recipe", F.array_join("kinds", ",").alias("phenotypes"), (n > 1).alias("error"), ((n == 1) & F.col("untagged")).alias("warning"))


def _centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).select("aoi_index", "recipe", "holdout", ((F.col("w") + F.col("e")) / 2.0).alias("lon"), ((F.col("s") + F.col("n")) / 2.0).alias("lat"))


def train_val_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _centres(spark, sf_dir)
    return A.close_pairs(at.where(~F.col("holdout")), at.where("holdout"), digits=3)


def recipe_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and warnings of each recipe: mixed phenotypes, areas without one beside those with one, and train areas too close to val areas."""
    at = _centres(spark, sf_dir)
    places = A.close_places(at.where(~F.col("holdout")), at.where("holdout"), by=("recipe",))
    leaks = places.groupBy("recipe").agg(F.sum(F.col("n") * F.col("val_n")).alias("leaks"))
    kind = F.nullif(F.col("phenotype"), F.lit(""))
    found = catalogue(spark, sf_dir).groupBy("recipe").agg(F.count_distinct(kind).alias("kinds"), F.min(kind).alias("one"), F.bool_or(F.col("phenotype") == "").alias("untagged"))
    joined = found.join(leaks, "recipe", "left").withColumn("leaks", F.coalesce("leaks", F.lit(0)))
    warning = F.when((F.col("kinds") == 1) & F.col("untagged"), A.untagged_warning(F.array("one")))
    return joined.select("recipe", "kinds", "leaks", ((F.col("kinds") <= 1) & (F.col("leaks") == 0)).alias("passes"), F.coalesce(warning, F.lit("")).alias("warnings"))


def aoi_grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey")
    text = F.concat_ws(",", *[x.cast("string") for x in (k * 10, k * 5, k * 10 + 3, k * 5 + 2)])
    box = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_name").alias("region"), geo.parse_bbox(text).alias("b")).select("region", "b.*")
    return box.select("region", F.explode(geo.grid_cells({x: F.col(x) for x in "wsen"}, 3, 2)).alias("c")).select("region", "c.name", *[F.round(f"c.{x}", 9).alias(x) for x in "wsen"])


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("aoi")).agg(F.count(F.lit(1)).alias("polygons"))
    k = F.col("aoi_index")
    spec = lambda i: F.element_at(F.array(*[F.lit(f[i]) for f in FEATURES.values()]), (k % 4 + 1).cast("int"))
    return (
        catalogue(spark, sf_dir).join(orders, F.col("aoi") == k, "left")
        .select("aoi_index", "region", "w", "s", "e", "n", ((k % 101) / 100.0).alias("valid_fraction"), F.coalesce("polygons", F.lit(0)).alias("n_polygons"), ((k % 13) / 100.0).alias("pixel_fraction"),
                F.coalesce(F.when(k % 10 == 0, 1), spec(0)).alias("min_count"), spec(1).alias("min_fraction"), F.lit(A.MIN_VALID_FRACTION).alias("min_valid"), F.when(k % 23 == 0, "timeout").alias("fetch_error"))
    )


def aoi_area_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.check(_facts(spark, sf_dir))
    return rows.select("aoi_index", F.round("area_km2", 9).alias("area_km2"), F.round("density", 9).alias("density"), F.array_join("warnings", ",").alias("warnings"))


def aoi_hard_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.check(_facts(spark, sf_dir)).select("aoi_index", "hard_pass", F.array_join("reasons", ",").alias("reasons"))


def check_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.check(_facts(spark, sf_dir)).select("aoi_index", A.notes(F.col("reasons"), F.col("warnings")).alias("notes"))


def aoi_soft_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.check(_facts(spark, sf_dir))
    return rows.select("aoi_index", *[F.round(F.col("soft")[x], 12).alias(x) for x in ("valid_fraction", "polygon_count", "pixel_fraction")], F.round("quality", 12).alias("quality"))


def aoi_quality_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best areas, the smaller index first in a tie."""
    return A.check(_facts(spark, sf_dir)).where("hard_pass").select("aoi_index", F.round("quality", 12).alias("quality")).orderBy(F.desc("quality"), "aoi_index").limit(20)


def feature_spec_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and layer of tile requests: 200, 404 for unknown features, 503 for models that aren't loaded, empty below zoom 15."""
    k = F.col("event_id")
    layer = F.create_map(*[F.lit(x) for pair in TILE_LAYERS.items() for x in pair])
    asked = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.element_at(F.array(*[F.lit(x) for x in (*TILE_LAYERS, "water")]), (k % 5 + 1).cast("int")).alias("feature"), (k % 6 + 12).alias("z"))
    status = A.tile_status(F.col("feature"), F.col("z"), list(TILE_LAYERS), [f for f in TILE_LAYERS if f != "parks"])
    return asked.select("event_id", status.alias("status"), F.when(status == "200", layer[F.col("feature")]).alias("layer"))


def smoke_and_train_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first area of each recipe, and how many train areas it has when its last one validates."""
    at = catalogue(spark, sf_dir)
    rest = A.all_but_last(at, "recipe").groupBy("recipe").agg(F.count(F.lit(1)).alias("rest"))
    return A.first_only(at, "recipe").select("recipe", F.col("aoi_index").alias("first")).join(rest, "recipe", "left").withColumn("rest", F.coalesce("rest", F.lit(0)))


QUERIES = {
    f.__name__: f
    for f in (smoke_and_train_areas, aoi_split, implicit_last_val, has_explicit_val, region_list, phenotype_consistency, train_val_leakage, recipe_validation, aoi_grid_cells, aoi_area_density, aoi_hard_filter, check_notes, aoi_soft_scores, aoi_quality_top, feature_spec_lookup)
}

_CATALOGUE = """a AS (
  SELECT c_custkey AS aoi_index, c_nationkey AS recipe, r_name AS region, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS phenotype, c_custkey % 5 = 0 AS holdout,
    (c_custkey % 40) * 0.001::DOUBLE + 130 AS w, ((c_custkey * 3) % 53) * 0.001::DOUBLE + 35 AS s FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), b AS (SELECT *, w + 0.01::DOUBLE AS e, s + 0.01::DOUBLE AS n FROM a)"""
_PAIRS = f"""{_CATALOGUE}, p AS (SELECT aoi_index, recipe, holdout, (w + e) / 2 AS lon, (s + n) / 2 AS lat FROM b), d AS (
  SELECT t.aoi_index AS train, v.aoi_index AS val, t.recipe AS train_recipe, v.recipe AS val_recipe,
    12742000::DOUBLE * asin(sqrt(pow(sin(radians(v.lat - t.lat) / 2), 2) + cos(radians(t.lat)) * cos(radians(v.lat)) * pow(sin(radians(v.lon - t.lon) / 2), 2))) AS metres
  FROM p t JOIN p v ON NOT t.holdout AND v.holdout
)"""
_SPEC = lambda i: "[" + ", ".join(f"{f[i]}" for f in FEATURES.values()) + "][aoi_index % 4 + 1]"
_CHECK = f"""{_CATALOGUE}, o AS (SELECT o_custkey AS aoi, count(*) AS polygons FROM orders GROUP BY 1), f AS (
  SELECT aoi_index, w, s, e, n, (aoi_index % 101) / 100::DOUBLE AS v, coalesce(polygons, 0) AS c, (aoi_index % 13) / 100::DOUBLE AS x, CASE WHEN aoi_index % 10 = 0 THEN 1 ELSE {_SPEC(0)} END AS min_count, ({_SPEC(1)})::DOUBLE AS min_fraction,
    aoi_index % 23 = 0 AS failed, greatest(0, (e - w) * 111.32::DOUBLE * cos(radians((s + n) / 2)) * ((n - s) * 110.57::DOUBLE)) AS area FROM b LEFT JOIN o ON aoi = aoi_index
), d AS (SELECT *, CASE WHEN area > 0 THEN c / area ELSE 0 END AS dens FROM f), k AS (
  SELECT *, CASE WHEN failed THEN ['imagery fetch failed: timeout'] ELSE [y FOR y IN [CASE WHEN v < 0.5 THEN 'valid_pixel_fraction ' || printf('%.3f', v) || ' < threshold 0.5' END, CASE WHEN min_count > 0 AND c < min_count THEN 'polygon_count ' || c || ' < feature.min_positive_polygon_count ' || min_count END,
      CASE WHEN min_fraction > 0 AND x < min_fraction THEN 'positive_pixel_fraction ' || printf('%.4f', x) || ' < feature.min_positive_pixel_fraction ' || min_fraction END] IF y IS NOT NULL] END AS reasons,
    CASE WHEN failed THEN []::VARCHAR[] ELSE [y FOR y IN [CASE WHEN dens > 0 AND dens < 100 THEN 'polygon_density_per_km2 ' || printf('%.0f', dens) || ' is low (rural? sparse OSM?)' END, CASE WHEN dens > 2000 THEN 'polygon_density_per_km2 ' || printf('%.0f', dens) || ' is ultra-dense; IoU will be bound by polygon boundary noise' END] IF y IS NOT NULL] END AS warnings,
    CASE WHEN failed THEN NULL WHEN v <= 0.5 THEN 0 WHEN v >= 1 THEN 1 ELSE (v - 0.5::DOUBLE) / 0.5::DOUBLE END AS sv, CASE WHEN failed THEN NULL WHEN min_count > 0 THEN least(1::DOUBLE, c / greatest(min_count * 5, 1)::DOUBLE) ELSE 1 END AS sc,
    CASE WHEN failed THEN NULL WHEN min_fraction > 0 THEN least(1::DOUBLE, x / greatest(min_fraction * 3, 0.01::DOUBLE)) ELSE 1 END AS sx FROM d
), q AS (SELECT *, round(coalesce((sv + sc + sx) / 3, 0), 12) AS quality FROM k)"""
SQL = {
    "aoi_split": f"""WITH {_CATALOGUE}, x AS (SELECT *, holdout OR region = 'ASIA' AS val FROM b), f AS (SELECT recipe, bool_or(val) AS any_val, count(*) AS k, max(aoi_index) AS last FROM x GROUP BY recipe)
SELECT aoi_index, x.recipe, CASE WHEN val OR (NOT any_val AND k > 1 AND aoi_index = last) THEN 'val' ELSE 'train' END AS split FROM x JOIN f ON x.recipe = f.recipe""",
    "smoke_and_train_areas": f"WITH {_CATALOGUE} SELECT recipe, min(aoi_index) AS first, count(*) - 1 AS rest FROM b GROUP BY recipe",
    "implicit_last_val": f"WITH {_CATALOGUE} SELECT recipe, max(aoi_index) AS aoi_index FROM b GROUP BY recipe HAVING count(*) > 1",
    "has_explicit_val": f"WITH {_CATALOGUE} SELECT recipe, bool_or(holdout OR region = 'ASIA') AS has_val FROM b GROUP BY recipe",
    "region_list": f"WITH {_CATALOGUE} SELECT phenotype, coalesce(string_agg(DISTINCT region, ',' ORDER BY region) FILTER (aoi_index % 3 <> 0), '') AS regions FROM b GROUP BY phenotype",
    "phenotype_consistency": f"""WITH {_CATALOGUE} SELECT recipe, coalesce(string_agg(DISTINCT phenotype, ',' ORDER BY phenotype) FILTER (phenotype <> ''), '') AS phenotypes, count(DISTINCT phenotype) FILTER (phenotype <> '') > 1 AS error,
  count(DISTINCT phenotype) FILTER (phenotype <> '') = 1 AND bool_or(phenotype = '') AS warning FROM b GROUP BY recipe""",
    "train_val_leakage": f"WITH {_PAIRS} SELECT train, val, round(metres, 3) AS metres FROM d WHERE metres < 200",
    "recipe_validation": f"""WITH {_PAIRS}, l AS (SELECT train_recipe AS recipe, count(*) AS leaks FROM d WHERE metres < 200 AND train_recipe = val_recipe GROUP BY 1), k AS (SELECT recipe, count(DISTINCT nullif(phenotype, '')) AS kinds, min(nullif(phenotype, '')) AS one, bool_or(phenotype = '') AS untagged FROM b GROUP BY recipe)
SELECT k.recipe, kinds, coalesce(leaks, 0)::BIGINT AS leaks, kinds <= 1 AND coalesce(leaks, 0) = 0 AS passes,
  CASE WHEN kinds = 1 AND untagged THEN 'some AOIs lack phenotype tag (others = [' || chr(39) || one || chr(39) || ']); recommend tagging all AOIs' ELSE '' END AS warnings FROM k LEFT JOIN l ON k.recipe = l.recipe""",
    "aoi_grid_cells": """WITH g AS (SELECT r_name AS region, r_regionkey AS k, unnest(range(6)) AS c FROM region), h AS (SELECT region, 'c' || c % 3 || 'r' || c // 3 AS name, k * 10 + (c % 3) * (3::DOUBLE / 3) AS w, k * 5 + (c // 3) * (2::DOUBLE / 2) AS s FROM g)
SELECT region, name, round(w, 9) AS w, round(s, 9) AS s, round(w + 1, 9) AS e, round(s + 1, 9) AS n FROM h""",
    "aoi_area_density": f"WITH {_CHECK} SELECT aoi_index, round(area, 9) AS area_km2, round(CASE WHEN failed THEN 0 ELSE dens END, 9) AS density, coalesce(array_to_string(warnings, ','), '') AS warnings FROM q",
    "aoi_hard_filter": f"WITH {_CHECK} SELECT aoi_index, len(reasons) = 0 AS hard_pass, coalesce(array_to_string(reasons, ','), '') AS reasons FROM q",
    "check_notes": f"WITH {_CHECK} SELECT aoi_index, coalesce(substr(array_to_string(list_concat(reasons[:1], warnings[:1]), '; '), 1, 40), '') AS notes FROM q",
    "aoi_soft_scores": f"WITH {_CHECK} SELECT aoi_index, round(sv, 12) AS valid_fraction, round(sc, 12) AS polygon_count, round(sx, 12) AS pixel_fraction, quality FROM q",
    "aoi_quality_top": f"WITH {_CHECK} SELECT aoi_index, quality FROM q WHERE len(reasons) = 0 ORDER BY quality DESC, aoi_index LIMIT 20",
    "feature_spec_lookup": """WITH r AS (SELECT event_id, ['buildings', 'roads', 'parkings', 'parks', 'water'][event_id % 5 + 1] AS f, event_id % 6 + 12 AS z FROM events), s AS (
  SELECT event_id, f, CASE WHEN z <= 14 THEN 'empty' WHEN f = 'water' THEN '404' WHEN f = 'parks' THEN '503' ELSE '200' END AS status FROM r
) SELECT event_id, status, CASE WHEN status = '200' THEN rtrim(f, 's') END AS layer FROM s""",
}
