"""Queries on catalogues and map features; orders stand for imagery items, parts for ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import attempts
from tessera.operators import catalogue as K
from tessera.operators.aoi import ranked
from tessera.operators.kernels import bound_batches

#: Successive ids of which a page of a payload holds those of its area.
PAGE_IDS = 1 << 14
_ASSET = "map<string,struct<href:string,type:string,alternate:map<string,struct<href:string>>>>"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = k.cast("string")
    asset = lambda href, kind, other: F.struct(href.alias("href"), F.lit(kind).alias("type"), other.alias("alternate"))
    web, store = F.concat(F.lit("https://x.example/"), name), F.concat(F.lit("s3://x/"), name)
    none = F.create_map().cast("map<string,struct<href:string>>")
    other = F.create_map(F.lit("http"), F.struct(web.alias("href")))
    assets = (
        F.when(k % 4 != 0, F.create_map(F.lit("thumbnail"), asset(store, "image/png", none), F.lit("visual"), asset(web, "image/tiff", none)))
        .when(k % 8 == 0, F.create_map(F.lit("metadata"), asset(web, "application/json", none), F.lit("cog"), asset(store, "image/tiff; application=GeoTIFF", other)))
        .otherwise(F.create_map(F.lit("metadata"), asset(web, "application/json", none)))
    ).cast(_ASSET)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_custkey").alias("aoi_index"), k.alias("pos"), name.alias("id"), F.when(k % 17 == 0, F.array(F.lit(1.0))).otherwise(F.array(*[F.lit(float(x)) for x in range(4)])).alias("bbox"),
        F.when(k % 19 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("datetime"), F.when(F.col("o_orderpriority").contains("NOT"), F.array(F.lit("DSM-1"))).alias("instruments"), F.lit("t").alias("title"),
        assets.alias("assets"), (k % 4 + 1).alias("bands"), F.array(F.lit("uint8"), F.lit("uint8"), F.when(k % 9 == 0, "float32").otherwise("uint8")).alias("dtypes"),
        F.when(k % 13 != 0, (F.floor("o_totalprice") % 100).cast("double")).alias("cloud_cover"),
    )


def stac_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.candidates(items(spark, sf_dir)).select("aoi_index", "id", K.gdal_path(F.col("href")).alias("path"), "rank")


def stac_first_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.first_usable(K.candidates(items(spark, sf_dir)))


def stac_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates that are tried for each area, with the reasons of those that can't serve."""
    return attempts.tried(K.candidates(items(spark, sf_dir))).select("aoi_index", "rank", "id", "reason")


def stac_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate that serves each area, how many were rejected before it, and the error where none serves."""
    found = attempts.chosen(K.candidates(items(spark, sf_dir)))
    return found.select("aoi_index", "id", F.size("rejects").cast("long").alias("rejected"), F.col("error").isNotNull().alias("failed"), F.coalesce(F.length("error"), F.lit(0)).alias("told"))


def feature_geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The geometries of every feature among all elements of an area, by a table function on each page of its payload.

    A page holds an area's elements of ``PAGE_IDS`` successive ids, so rows stay small however large an area is.
    It is narrowed to those of the feature, which keep their positions among all elements of the area.
    """
    bound_batches(spark)
    at = ["aoi_index", "page"]
    way = ways(spark, sf_dir).withColumns({"aoi_index": F.col("id") % 50, "page": F.floor(F.col("id") / PAGE_IDS)})
    before = Window.partitionBy("aoi_index").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    first = way.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).select(*at, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    element = F.struct(F.col("id").alias("k"), "type", F.col("coords").alias("geometry"), F.to_json("tags").alias("told"))
    own = F.transform(
        F.sort_array(F.collect_list(element)),
        lambda x, i: F.struct(x["k"].alias("id"), x["type"].alias("type"), x["geometry"].alias("geometry"), F.from_json(x["told"], "map<string,string>").alias("tags"), i.alias("nth")),
    )
    payload = way.groupBy(*at).agg(own.alias("elements")).join(first, at)
    of = lambda f: F.struct(F.lit(f).alias("feature"), F.filter("elements", lambda e: K.feature_predicate(f, e["tags"])).alias("elements"))
    pages = payload.select("first", F.explode(F.array(*[of(f) for f in K.FEATURES])).alias("p")).select("first", "p.*")
    nth = F.transform("elements", lambda e: (F.col("first") + e["nth"]).cast("long"))
    rows = pages.select("feature", "elements", nth.alias("nth")).lateralJoin(attempts.geometries(F.col("feature").outer(), F.col("elements").outer(), F.col("nth").outer()))
    return rows.groupBy("feature", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("line")).alias("corners"), F.sum("ord").alias("ords"))


def top_ranked_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(items(spark, sf_dir), "aoi_index", F.coalesce("datetime", F.lit("")).desc(), F.col("pos")).where("rank <= 2").select("aoi_index", "id", "rank")


def cloud_then_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.cloud_then_newest(items(spark, sf_dir)).select("aoi_index", "id", "rank", K.datetime_digits(F.col("datetime")).alias("digits"))


def json_props_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.from_json("props", "k INT").alias("p"))
    return events.groupBy("event_type").agg(F.count("p.k").alias("n"), F.sum("p.k").alias("total"), F.min("p.k").alias("least"), F.max("p.k").alias("most"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways of 0 to 5 corners with tags; even ones of four or more are closed, and every eleventh is a relation."""
    k, n = F.col("p_partkey"), F.col("p_size") % 6
    corner = lambda i: F.struct((k % 10 + i % 3).cast("double").alias("lon"), (i * 1.0).cast("double").alias("lat"))
    open_ = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), corner)).otherwise(F.array().cast("array<struct<lon:double,lat:double>>"))
    closed = (k % 2 == 0) & (n >= 4)
    coords = F.when(closed, F.concat(F.slice(open_, F.lit(1), n - 1), F.slice(open_, 1, 1))).otherwise(open_)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("motorway", "residential", "service", "footway", "primary_link")]), (k % 5 + 1).cast("int"))
    width = F.when(k % 3 == 0, F.concat(F.col("p_size").cast("string"), F.when(k % 2 == 0, " m").otherwise("m"))).when(k % 3 == 1, F.when(k % 4 == 0, "wide"))
    lanes = F.when(k % 7 < 3, F.concat((F.col("p_size") % 4).cast("string"), F.lit(";3")))
    pairs = [("highway", kind), ("width", width), ("lanes", lanes), ("building", F.when(k % 6 == 0, "yes")), ("leisure", F.when(k % 8 == 0, "park").when(k % 8 == 1, "pitch")), ("landuse", F.when(k % 9 == 0, "recreation_ground")), ("parking", F.when(k % 10 == 0, "surface"))]
    tags = F.map_filter(F.create_map(*[x for key, v in pairs for x in (F.lit(key), v)]), lambda _, v: v.isNotNull())
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("id"), F.when(k % 11 == 0, "relation").otherwise("way").alias("type"), coords.alias("coords"), tags.alias("tags"))


def road_width_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ways(spark, sf_dir).select("id", K.width_m(F.col("tags")).alias("width_m"))


def way_geometry_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ways(spark, sf_dir).where("type = 'way'").select("id", K.way_kind(F.col("coords")).alias("kind"), F.size("coords").alias("corners")).where("kind IS NOT NULL")


def polygon_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ways(spark, sf_dir).where("type = 'way'").where(K.way_kind(F.col("coords")) == "Polygon").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def feature_tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = lambda f: K.feature_predicate(f, F.col("tags")).alias(f)
    return ways(spark, sf_dir).select("id", *[test(f) for f in ("building", "park", "parking", "road")]).where("building OR park OR parking OR road")


QUERIES: dict = {f.__name__: f for f in (stac_candidates, stac_first_usable, stac_attempts, stac_choice, feature_geometries, top_ranked_item, cloud_then_newest, json_props_scan, road_width_resolution, way_geometry_kind, polygon_ways, feature_tag_filter)}

_ITEMS = """i AS (
  SELECT o_custkey AS aoi_index, o_orderkey AS k, CASE WHEN o_orderkey % 19 <> 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS dt, o_orderpriority LIKE '%NOT%' AS dsm,
    CASE WHEN o_orderkey % 13 <> 0 THEN floor(o_totalprice)::BIGINT % 100 ELSE 100 END AS cloud FROM orders
), c AS (
  SELECT *, row_number() OVER (PARTITION BY aoi_index ORDER BY coalesce(dt, '') DESC, k)::INT AS rank FROM i WHERE NOT dsm AND k % 17 <> 0 AND (k % 4 <> 0 OR k % 8 = 0)
)"""
_TRIED = f"""{_ITEMS}, j AS (
  SELECT aoi_index, rank, k::VARCHAR AS id, CASE WHEN k % 4 + 1 < 3 THEN 'COG has ' || (k % 4 + 1) || ' band(s); RGB needs >= 3'
    WHEN k % 9 = 0 THEN 'COG dtypes (''uint8'', ''uint8'', ''float32'') not in {{''uint8''}} (likely a DSM / elevation product masquerading as imagery)' END AS reason FROM c
), u AS (SELECT *, min(rank) FILTER (reason IS NULL) OVER (PARTITION BY aoi_index) AS stop FROM j QUALIFY rank <= coalesce(stop, rank))"""
_WIDTHS = "MAP {'motorway': 12.0, 'residential': 5.0, 'service': 3.5, 'primary_link': 6.0}"
_WAYS = """w AS (
  SELECT p_partkey AS k, p_size AS z, p_size % 6 AS n, ['motorway', 'residential', 'service', 'footway', 'primary_link'][p_partkey % 5 + 1] AS highway FROM part
)"""
SQL = {
    "stac_candidates": f"WITH {_ITEMS} SELECT aoi_index, k::VARCHAR AS id, '/vsicurl/https://x.example/' || k AS path, rank FROM c",
    "stac_first_usable": f"""WITH {_ITEMS}, u AS (SELECT *, k % 4 + 1 >= 3 AND k % 9 <> 0 AS ok FROM c)
SELECT aoi_index, arg_min(k::VARCHAR, rank) FILTER (ok) AS id, 'https://x.example/' || (arg_min(k::VARCHAR, rank) FILTER (ok)) AS href, count(*) FILTER (NOT ok)::BIGINT AS rejected FROM u GROUP BY aoi_index""",
    "stac_attempts": f"""WITH {_TRIED} SELECT aoi_index, rank, id, reason FROM u""",
    "stac_choice": f"""WITH {_TRIED} SELECT aoi_index, max(id) FILTER (reason IS NULL) AS id, count(reason)::BIGINT AS rejected, count(*) = count(reason) AS failed,
  CASE WHEN count(*) = count(reason) THEN (26 + sum(length(id) + 2 + length(reason)) + 2 * (count(*) - 1))::INT ELSE 0 END AS told FROM u GROUP BY aoi_index""",
    "feature_geometries": f"""WITH {_WAYS}, e AS (SELECT *, row_number() OVER (PARTITION BY k % 50 ORDER BY k) - 1 AS ord FROM w), t AS (
  SELECT *, unnest(['building', 'park', 'parking', 'road']) AS feature, unnest([k % 6 = 0, k % 8 = 0 OR k % 9 = 0, k % 10 = 0, highway <> 'footway']) AS has FROM e WHERE k % 11 <> 0 AND n >= 2
) SELECT feature, CASE WHEN k % 2 = 0 AND n >= 4 THEN 'Polygon' ELSE 'LineString' END AS kind, count(*)::BIGINT AS n, sum(n)::BIGINT AS corners, sum(ord)::BIGINT AS ords FROM t WHERE has GROUP BY ALL""",
    "top_ranked_item": f"WITH {_ITEMS} SELECT aoi_index, k::VARCHAR AS id, row_number() OVER (PARTITION BY aoi_index ORDER BY coalesce(dt, '') DESC, k)::INT AS rank FROM i QUALIFY rank <= 2",
    "cloud_then_newest": f"""WITH {_ITEMS}, d AS (SELECT *, coalesce(substr(translate(dt, '-:TZ ', ''), 1, 14)::BIGINT, 0) AS digits FROM i)
SELECT aoi_index, k::VARCHAR AS id, row_number() OVER (PARTITION BY aoi_index ORDER BY cloud, digits DESC, k)::INT AS rank, digits FROM d""",
    "json_props_scan": "WITH e AS (SELECT event_type, (props->>'k')::INT AS k FROM events) SELECT event_type, count(k)::BIGINT AS n, sum(k)::BIGINT AS total, min(k) AS least, max(k) AS most FROM e GROUP BY event_type",
    "road_width_resolution": f"""WITH {_WAYS} SELECT k AS id, CASE WHEN k % 3 = 0 AND z > 0 THEN z::DOUBLE WHEN k % 7 < 3 AND z % 4 > 0 THEN (z % 4) * 3.5::DOUBLE ELSE coalesce(({_WIDTHS})[highway], 4)::DOUBLE END AS width_m FROM w""",
    "way_geometry_kind": f"WITH {_WAYS} SELECT k AS id, CASE WHEN k % 2 = 0 AND n >= 4 THEN 'Polygon' ELSE 'LineString' END AS kind, n AS corners FROM w WHERE k % 11 <> 0 AND n >= 2",
    "polygon_ways": f"WITH {_WAYS} SELECT count(*)::BIGINT AS n, sum(k)::BIGINT AS ids FROM w WHERE k % 11 <> 0 AND k % 2 = 0 AND n >= 4",
    "feature_tag_filter": f"""WITH {_WAYS}, t AS (SELECT k AS id, k % 6 = 0 AS building, k % 8 = 0 OR k % 9 = 0 AS park, k % 10 = 0 AS parking, highway <> 'footway' AS road FROM w) SELECT * FROM t WHERE building OR park OR parking OR road""",
}
