"""Queries that search payload files; the files are written from orders and parts and lie in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import catalogue as K
from tessera.plans import catalogue
from tessera.sources import readers
from tessera.sources.scratch import shared_folder

BOX = (-20.0, -30.0, 25.0, 30.0)
SINCE, UNTIL, LIMIT = "1994-06-01T00:00:00Z", "1997-06-30T00:00:00Z", 2
AREAS_PER_FILE = 50


def _files(areas: DataFrame) -> int:
    return max(8, areas.select("aoi_index").distinct().count() // AREAS_PER_FILE)


def item_payloads(spark: SparkSession, sf_dir: str) -> str:
    """The folder of catalogue payloads: an area for each customer, an item for each order."""
    k, c = F.col("pos"), F.col("aoi_index")
    w, s = (c * 37) % 1200 / 4 - 150 + k % 5 * 0.25, (c * 53) % 480 / 4 - 60
    box = F.when(k % 17 == 0, F.array(w)).otherwise(F.array(w, s, w + 0.5, s + 0.5))
    properties = F.struct("datetime", "instruments", "title", F.col("cloud_cover").alias("eo:cloud_cover"))
    feature = F.struct(k.alias("ord"), "id", box.alias("bbox"), properties.alias("properties"), F.to_json("assets").alias("told"))
    cover = [F.when(F.size("bbox") == 4, F.get("bbox", F.lit(i))) for i in range(4)]
    rows = catalogue.items(spark, sf_dir).withColumn("bbox", box).withColumn("feature", feature)
    areas = rows.groupBy("aoi_index").agg(
        F.sort_array(F.collect_list("feature")).alias("x"), *[f(x).alias(name) for f, x, name in zip((F.min, F.min, F.max, F.max), cover, "wsen", strict=True)], F.min("datetime").alias("since"), F.max("datetime").alias("until")
    )
    path = shared_folder(spark, "items")
    kind = catalogue._ASSET
    features = F.transform("x", lambda x: F.struct(x["id"].alias("id"), x["bbox"].alias("bbox"), x["properties"].alias("properties"), F.from_json(x["told"], kind).alias("assets")))
    readers.write_payloads(areas.withColumn("features", features).drop("x"), path, _files(rows), "features", "w")
    return path


def way_payloads(spark: SparkSession, sf_dir: str) -> str:
    """The folder of map payloads: ten parts are the elements of an area."""
    rows = catalogue.ways(spark, sf_dir).withColumn("aoi_index", F.floor(F.col("id") / 10))
    shift = F.col("aoi_index") % 300 - 150
    moved = F.transform("coords", lambda p: F.struct(p["lat"].alias("lat"), (p["lon"] + shift).alias("lon")))
    side = lambda name: F.transform("geometry", lambda p: p[name])
    cover = [F.min(F.array_min(side("lon"))).alias("w"), F.min(F.array_min(side("lat"))).alias("s"), F.max(F.array_max(side("lon"))).alias("e"), F.max(F.array_max(side("lat"))).alias("n")]
    # maps have no order, so tags travel as text until the elements are sorted
    own = F.sort_array(F.collect_list(F.struct("id", "type", "geometry", F.to_json("tags").alias("told"))))
    areas = rows.withColumn("geometry", moved).groupBy("aoi_index").agg(own.alias("x"), *cover)
    none = F.lit(None).cast("string")
    elements = F.transform("x", lambda x: F.struct(x["id"].alias("id"), x["type"].alias("type"), x["geometry"].alias("geometry"), F.from_json(x["told"], "map<string,string>").alias("tags")))
    path = shared_folder(spark, "ways")
    readers.write_payloads(areas.select("aoi_index", elements.alias("elements"), "w", "s", "e", "n", none.alias("since"), none.alias("until")), path, _files(rows), "elements", "w")
    return path


def catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first items of each area in a box and a time, and of these the ones south of the equator; files that can't hold any are not opened."""
    found = readers.search(spark, "open_imagery", item_payloads(spark, sf_dir), BOX, SINCE, UNTIL, LIMIT)
    return found.where(F.col("n") <= 0.0).select("aoi_index", "pos", "id", "w", "s", "datetime", "cloud_cover")


def usable_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a search that can serve, newest first within their area."""
    found = readers.search(spark, "cloud_imagery", item_payloads(spark, sf_dir), BOX)
    items = found.withColumn("bbox", F.when(F.col("w").isNotNull(), F.array("w", "s", "e", "n")))
    return K.candidates(items).select("aoi_index", "id", "href", "rank")


def map_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads among the elements of a map in a box, with their widths."""
    found = readers.search(spark, "map_features", way_payloads(spark, sf_dir), BOX)
    roads = found.where((F.col("type") == "way") & K.feature_predicate("road", F.col("tags")))
    return roads.select("aoi_index", "id", "w", "e", F.size("coords").alias("corners"), K.width_m(F.col("tags")).alias("width_m"))


QUERIES = {f.__name__: f for f in (catalogue_search, usable_search, map_search)}

_BOX = "w <= 25 AND e >= -20 AND s <= 30 AND n >= -30"
_ITEMS = f"""{catalogue._ITEMS}, placed AS (
  SELECT *, (aoi_index * 37) % 1200 / 4::DOUBLE - 150 + k % 5 * 0.25::DOUBLE AS w, (aoi_index * 53) % 480 / 4::DOUBLE - 60 AS s, row_number() OVER (PARTITION BY aoi_index ORDER BY k) - 1 AS pos FROM i
), b AS (SELECT *, w + 0.5::DOUBLE AS e, s + 0.5::DOUBLE AS n FROM placed WHERE k % 17 <> 0)"""
SQL = {
    "catalogue_search": f"""WITH {_ITEMS}, f AS (
  SELECT *, row_number() OVER (PARTITION BY aoi_index ORDER BY k) AS place FROM b WHERE {_BOX} AND dt >= '{SINCE}' AND dt <= '{UNTIL}'
) SELECT aoi_index, pos::INT AS pos, k::VARCHAR AS id, w, s, dt AS datetime, CASE WHEN k % 13 <> 0 THEN cloud::DOUBLE END AS cloud_cover FROM f WHERE place <= {LIMIT} AND n <= 0""",
    "usable_search": f"""WITH {_ITEMS}
SELECT aoi_index, k::VARCHAR AS id, 'https://x.example/' || k AS href, row_number() OVER (PARTITION BY aoi_index ORDER BY coalesce(dt, '') DESC, k)::INT AS rank
FROM b WHERE {_BOX} AND NOT dsm AND (k % 4 <> 0 OR k % 8 = 0)""",
    "map_search": f"""WITH {catalogue._WAYS}, r AS (
  SELECT *, k // 10 AS aoi, unnest(range(n)) AS i FROM w WHERE k % 11 <> 0 AND n >= 1 AND highway <> 'footway'
), g AS (
  SELECT k AS id, any_value(aoi) AS aoi_index, any_value(z) AS z, any_value(n) AS corners, any_value(highway) AS highway,
    min(k % 10 + j % 3 + aoi % 300 - 150)::DOUBLE AS w, max(k % 10 + j % 3 + aoi % 300 - 150)::DOUBLE AS e, min(j)::DOUBLE AS s, max(j)::DOUBLE AS n
  FROM (SELECT *, CASE WHEN k % 2 = 0 AND n >= 4 AND i = n - 1 THEN 0 ELSE i END AS j FROM r) GROUP BY k
) SELECT aoi_index, id, w, e, corners, CASE WHEN id % 3 = 0 AND z > 0 THEN z::DOUBLE WHEN id % 7 < 3 AND z % 4 > 0 THEN (z % 4) * 3.5::DOUBLE ELSE coalesce(({catalogue._WIDTHS})[highway], 4)::DOUBLE END AS width_m FROM g WHERE {_BOX}""",
}
