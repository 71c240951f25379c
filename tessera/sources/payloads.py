"""Scans of catalogue and map payloads in JSON files, with explicit schemas, and sources by name.

Live services need a network; a source reads what was fetched before: payloads, vector tiles, tiled TIFF.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import catalogue as K
from tessera.operators import geometry as G
from tessera.operators.aoi import ranked
from tessera.sources import images

STAC = """features array<struct<id: string, collection: string, bbox: array<double>,
  properties: struct<datetime: string, instruments: array<string>, title: string, `eo:cloud_cover`: double>,
  assets: map<string, struct<href: string, type: string, alternate: map<string, struct<href: string>>>>>>"""
OVERPASS = "elements array<struct<type: string, geometry: array<struct<lat: double, lon: double>>, tags: map<string,string>>>"


def _features(spark: SparkSession, path: str) -> DataFrame:
    """One row for each feature of each file; a file is an area."""
    payload = spark.read.schema(STAC).option("multiLine", True).json(path).withColumn("aoi_index", F.input_file_name())
    f = payload.select("aoi_index", F.posexplode("features").alias("pos", "f"))
    return f.select("aoi_index", "pos", "f.id", "f.bbox", F.col("f.properties.datetime").alias("datetime"), F.col("f.properties.instruments").alias("instruments"), F.col("f.properties.title").alias("title"), F.col("f.properties.eo:cloud_cover").alias("cloud_cover"), "f.assets")


#: Features of a search that the two catalogues return at most.
OPEN_LIMIT, CLOUD_LIMIT = 20, 10


def _searched(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None, since: str | None, until: str | None, limit: int | None) -> DataFrame:
    """The features of a search as the service would answer it: those that meet a box and a time, the first ``limit`` of each area."""
    found = _features(spark, path)
    if box is not None:
        w, s, e, n = (F.lit(float(x)) for x in box)
        at = [F.get("bbox", F.lit(i)) for i in range(4)]
        found = found.where((F.size("bbox") == 4) & (at[0] <= e) & (at[2] >= w) & (at[1] <= n) & (at[3] >= s))
    if since is not None:
        found = found.where(F.col("datetime") >= since)
    if until is not None:
        found = found.where(F.col("datetime") <= until)
    if limit is not None:
        found = ranked(found, "aoi_index", F.col("pos")).where(F.col("rank") <= limit).drop("rank")
    return found


def open_imagery(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, since: str | None = None, until: str | None = None, limit: int | None = OPEN_LIMIT) -> DataFrame:
    """(aoi_index, id, bbox, datetime, href, rank) of items that can serve, newest first, then in their order.

    A file holds what a search returned; ``box``, ``since``, ``until`` (ISO times) and ``limit`` ask for less of it.
    """
    return K.candidates(_searched(spark, path, box, since, until, limit)).select("aoi_index", "id", "bbox", "datetime", "href", "rank")


def cloud_imagery(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, since: str | None = None, until: str | None = None, limit: int | None = CLOUD_LIMIT) -> DataFrame:
    """(aoi_index, id, bbox, datetime, href, cloud_cover, rank) of items with a ``visual`` asset, clearest first, then newest."""
    kept = _searched(spark, path, box, since, until, limit).withColumn("href", F.try_element_at("assets", F.lit("visual"))["href"]).where((F.size("bbox") == 4) & F.col("href").isNotNull())
    return K.cloud_then_newest(kept).select("aoi_index", "id", "bbox", "datetime", "href", "cloud_cover", "rank")


def map_features(spark: SparkSession, path: str) -> DataFrame:
    """(aoi_index, ord, kind, coords, tags) of ways that have a shape; relations and invalid or empty shapes are dropped."""
    payload = spark.read.schema(OVERPASS).option("multiLine", True).json(path).withColumn("aoi_index", F.input_file_name())
    e = payload.select("aoi_index", F.posexplode("elements").alias("ord", "e")).where("e.type = 'way'")
    coords = F.transform("e.geometry", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    empty = F.create_map().cast("map<string,string>")
    return e.select("aoi_index", "ord", coords.alias("coords"), F.coalesce("e.tags", empty).alias("tags")).withColumn("kind", K.way_kind(F.col("coords"))).where(F.col("kind").isNotNull() & G.valid_way(F.col("kind"), F.transform("coords", lambda c: F.array(c["lon"], c["lat"]))))


def map_polygons(spark: SparkSession, path: str) -> DataFrame:
    return map_features(spark, path).where("kind = 'Polygon'")


def vector_tiles(spark: SparkSession, path: str, layer: str = "building") -> DataFrame:
    """(path, id, rings) of the polygons of a layer in files of vector tiles; rings are in tile steps, the outer one first."""
    tiles = spark.read.format("binaryFile").load(path)
    return tiles.select("path", F.explode(G.tile_features_of(F.col("content"), layer)).alias("f")).select("path", "f.id", "f.rings")


def pixels(spark: SparkSession, path: str) -> DataFrame:
    """The images of a folder of tiled TIFF files (``*.tif``), whole; ``images.read_windows`` reads parts of them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(path).select("path")
    whole = F.lit(None).cast("int")
    return images.read_windows(files.select("path", F.lit(0).alias("row"), F.lit(0).alias("col"), whole.alias("last_row"), whole.alias("last_col")))


SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"open_imagery": open_imagery, "cloud_imagery": cloud_imagery, "map_features": map_features, "map_polygons": map_polygons, "vector_tiles": vector_tiles, "pixels": pixels}


def source(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """The source of a name; a KeyError names those that there are."""
    if name not in SOURCES:
        raise KeyError(f"unknown source {name!r}; there are {', '.join(sorted(SOURCES))}")
    return SOURCES[name]
