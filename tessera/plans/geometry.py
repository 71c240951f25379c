"""Queries on geometry: pixel areas, grids, projections, tiles, buffers, outlines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.operators import aoi as A
from tessera.operators import catalogue as K
from tessera.operators import geometry as G
from tessera.plans import catalogue, raster


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    w, s = (k % 340) - 170.0, ((k * 7) % 120) - 59.75
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("id"), w.alias("w"), s.alias("s"), (w + 0.5 + (k % 7) * 0.3).alias("e"), (s + 0.4 + (k % 5) * 0.3).alias("n"), F.element_at(F.array(*[F.lit(x) for x in ("EPSG:3857", "epsg: 3857", "EPSG:32654")]), (k % 3 + 1).cast("int")).alias("crs"))


def pixel_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = geo.pixel_area_m2(F.lit(0.5), F.lit(-0.5), F.col("crs"), F.col("s"), F.col("n"))
    return _boxes(spark, sf_dir).select("id", F.round(area, 9).alias("pixel_area_m2"))


def output_grid_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = geo.output_size(F.col("e") - F.col("w"), F.col("n") - F.col("s"), 1024)
    return _boxes(spark, sf_dir).select("id", w.alias("out_w"), h.alias("out_h"))


def mercator_reproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.mercator_x(F.col("w")), geo.mercator_y(F.col("s"))
    return _boxes(spark, sf_dir).select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(geo.lon_of(x), 9).alias("lon"), F.round(geo.lat_of(y), 9).alias("lat"))


def tile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    z, x, y = k % 5 + 12, (k * 31) % 4096, (k * 17) % 4096
    b = geo.tile_bounds(z.cast("double"), x, y)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", *[F.round(c, 6).alias(n) for n, c in b.items()])


def tile_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of each chip as polygons of a tile: status gate, strict threshold, area cap in uncorrected Mercator, 4096 steps over the tile's degrees.

    Tiles are written as bytes and read back. A row for each component: the layer, how many rings it has and its
    command stream, which tells the rings' order, winding and corners in steps.
    """
    v = F.col("vec_id")
    z, x, y = v % 6 + 13, (v * 31) % 4096, (v * 17) % 4096
    b = geo.tile_bounds(z.cast("double"), x, y)
    size = geo.tile_size_m(z.cast("double")) / 8
    served = A.tile_status(F.lit("buildings"), z, ["buildings"], ["buildings"]) == "200"
    label = raster.R.labels(F.transform("px", lambda p: raster.M.above(p["p"], 0.6).cast("int")), raster.H.SIDE)
    found = raster.H.chips(spark, sf_dir).where(served).select("vec_id", label.alias("label")).select("vec_id", raster.R.sizes(F.col("label")).alias("sizes"), G.polygons(F.col("label"), raster.H.SIDE).alias("shapes"))
    small = F.transform(F.filter("sizes", lambda s: s["size"] * size * size <= F.lit(10_000)), lambda s: s["component"])
    corner = lambda p: F.array(
        geo.quantize(geo.lon_of(b["west"] + p[0] * size), geo.lon_of(b["west"]), geo.lon_of(b["east"])),
        4096 - geo.quantize(geo.lat_of(b["north"] - p[1] * size), geo.lat_of(b["south"]), geo.lat_of(b["north"])),
    )
    ring = lambda r: F.transform(r, corner)
    feature = lambda f: F.struct(f["component"].alias("id"), F.concat(F.array(ring(f["shell"])), F.transform(f["holes"], ring)).alias("rings"))
    tile = found.select("vec_id", F.transform(F.filter("shapes", lambda f: F.array_contains(small, f["component"])), feature).alias("features")).select("vec_id", G.tile_bytes("building", F.col("features")).alias("tile"))
    return tile.select("vec_id", F.explode(G.tile_features_of(F.col("tile"), "building")).alias("f")).select("vec_id", F.col("f.id").cast("int").alias("component"), F.lit("building").alias("layer"), F.size("f.rings").alias("n_rings"), F.array_join(F.col("f.commands").cast("array<string>"), " ").alias("commands"))


def valid_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways that have a shape: simple rings, and lines of two different corners."""
    line = F.transform("coords", lambda c: F.array(c["lon"], c["lat"]))
    way = catalogue.ways(spark, sf_dir).where("type = 'way'").withColumn("kind", K.way_kind(F.col("coords"))).where(F.col("kind").isNotNull())
    return way.where(G.valid_way(F.col("kind"), line)).select("id", "kind")


def grid_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = geo.output_size(F.col("e") - F.col("w"), F.col("n") - F.col("s"), 1024)
    t = geo.affine(F.col("w"), F.col("s"), F.col("e"), F.col("n"), w, h)
    return _boxes(spark, sf_dir).select("id", t.alias("t")).select("id", *[F.round(f"t.{x}", 12).alias(x) for x in "abcdef"])


def road_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat-capped rectangles of road segments; the first way of each area gives the latitude."""
    line = catalogue.ways(spark, sf_dir).where(K.way_kind(F.col("coords")) == "LineString").withColumn("aoi", F.col("id") % 50)
    lat = F.aggregate("coords", F.lit(0.0), lambda a, c: a + c["lat"]) / F.size("coords")
    first = line.select("aoi", "id", lat.alias("lat")).groupBy("aoi").agg(F.min_by("lat", "id").alias("lat_ref"))
    half = G.buffer_degrees(K.width_m(F.col("tags")), F.col("lat_ref"))
    quads = G.buffer_lines(F.transform("coords", lambda c: F.array(c["lon"], c["lat"])), F.col("half"))
    made = line.join(first, "aoi").withColumn("half", half).select("id", "half", F.explode(quads).alias("q"))
    area = lambda q: F.abs(F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0.0), lambda a, i: a + F.get(F.get(q, i), F.lit(0)) * F.get(F.get(q, (i + 1) % 4), F.lit(1)) - F.get(F.get(q, (i + 1) % 4), F.lit(0)) * F.get(F.get(q, i), F.lit(1)))) / 2
    return made.select("id", "half", area(F.col("q")).alias("a")).groupBy("id").agg(F.count(F.lit(1)).alias("segments"), F.round(F.max("half"), 12).alias("half_deg"), F.round(F.sum("a"), 9).alias("area"))


def road_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffers of lines as one shape, wide enough to see their joins: area, rings and the farthest reach to the east."""
    line = catalogue.ways(spark, sf_dir).where(K.way_kind(F.col("coords")) == "LineString").select("id", "coords")
    line = line.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")  # a small file of many lines is much work
    half = 0.05 + F.col("id") % 4 * 0.05
    made = line.select("id", half.alias("half"), G.buffer_shape(F.transform("coords", lambda c: F.array(c["lon"], c["lat"])), half).alias("b"))
    return made.select("id", F.round("half", 9).alias("half"), F.round("b.area", 9).alias("area"), F.size("b.rings").alias("rings"))


def component_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygons of components: their area, that of the shell with its holes filled, how many holes they have and the largest one."""
    shape = raster.masks(spark, sf_dir, 0.4).select("vec_id", F.explode(G.polygons(F.col("label"), raster.H.SIDE)).alias("f")).select("vec_id", "f.*")

    def signed(ring):  # noqa: ANN001, ANN202
        after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
        return F.aggregate(F.zip_with(ring, after, lambda a, b: a[0] * b[1] - b[0] * a[1]), F.lit(0), lambda x, y: x + y) / 2

    holes = F.transform("holes", lambda r: -signed(r).cast("long"))
    area = signed(F.col("shell")).cast("long") - F.aggregate(holes, F.lit(0).cast("long"), lambda x, y: x + y)
    return shape.select("vec_id", "component", area.alias("area"), signed(F.col("shell")).cast("long").alias("filled"), F.size("holes").cast("long").alias("holes"), F.coalesce(F.array_max(holes), F.lit(0)).alias("largest_hole"))


QUERIES = {f.__name__: f for f in (pixel_area, output_grid_size, mercator_reproject, tile_bounds, tile_features, road_buffer, road_shapes, component_outlines, valid_ways, grid_affine)}

_BOXES = """b AS (SELECT c_custkey AS id, c_custkey % 340 - 170::DOUBLE AS w, (c_custkey * 7) % 120 - 59.75::DOUBLE AS s, c_custkey AS k FROM customer), x AS (
  SELECT *, w + 0.5::DOUBLE + (k % 7) * 0.3::DOUBLE AS e, s + 0.4::DOUBLE + (k % 5) * 0.3::DOUBLE AS n FROM b)"""
_EDGE, _R = math.pi * geo.MERCATOR_M, geo.MERCATOR_M
SQL = {
    "pixel_area": f"WITH {_BOXES} SELECT id, round(CASE WHEN k % 3 = 2 THEN 0.25 ELSE 0.25 * cos(radians((s + n) / 2)) * cos(radians((s + n) / 2)) END, 9) AS pixel_area_m2 FROM x",
    "output_grid_size": f"""WITH {_BOXES}, r AS (SELECT id, (e - w) / (n - s) AS r FROM x)
SELECT id, CASE WHEN r >= 1 THEN 1024 ELSE greatest(1, round_even(1024 * r, 0)::INT) END AS out_w, CASE WHEN r >= 1 THEN greatest(1, round_even(1024 / r, 0)::INT) ELSE 1024 END AS out_h FROM r""",
    "mercator_reproject": f"""WITH {_BOXES}, m AS (SELECT id, radians(w) * {_R}::DOUBLE AS x, ln(tan(pi() / 4 + radians(s) / 2)) * {_R}::DOUBLE AS y FROM x)
SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(degrees(x / {_R}::DOUBLE), 9) AS lon, round(degrees(2 * atan(exp(y / {_R}::DOUBLE)) - pi() / 2), 9) AS lat FROM m""",
    "tile_bounds": f"""WITH t AS (SELECT page_id, (page_id * 31) % 4096 AS x, (page_id * 17) % 4096 AS y, {2 * _EDGE!r}::DOUBLE / pow(2::DOUBLE, page_id % 5 + 12) AS size FROM pages)
SELECT page_id, round(x * size - {_EDGE!r}::DOUBLE, 6) AS west, round({_EDGE!r}::DOUBLE - (y + 1) * size, 6) AS south, round((x + 1) * size - {_EDGE!r}::DOUBLE, 6) AS east, round({_EDGE!r}::DOUBLE - y * size, 6) AS north FROM t""",
    "tile_features": f"""WITH RECURSIVE {raster.H.SQL}, {raster._labelled("SELECT vec_id, i FROM px WHERE p > 0.6 AND vec_id % 6 >= 2")}, d AS (
  SELECT lab.vec_id, component, i // 8 AS r, i % 8 AS c, {2 * _EDGE!r}::DOUBLE / pow(2::DOUBLE, lab.vec_id % 6 + 13) AS size, n FROM lab JOIN sz USING (vec_id, component)
), k AS (SELECT * FROM d WHERE n * (size / 8) * (size / 8) <= 10000), s AS (  -- directed sides with the component on the right: top, right, bottom, left
  SELECT k.vec_id, k.component, k.size, (r + oy) * 9 * 4 + (c + ox) * 4 + way AS id, way, c + ox AS x, r + oy AS y, c + ox + CASE way WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS x2, r + oy + CASE way WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS y2
  FROM k, (SELECT unnest([0, 1, 2, 3]) AS way, unnest([-1, 0, 1, 0]) AS dr, unnest([0, 1, 0, -1]) AS dc, unnest([0, 1, 1, 0]) AS ox, unnest([0, 0, 1, 1]) AS oy)
  WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.vec_id = k.vec_id AND o.component = k.component AND o.r = k.r + dr AND o.c = k.c + dc)
), nxt AS (  -- to the right first, then straight on, then to the left
  SELECT a.vec_id, a.component, a.id, b.id AS follows FROM s a JOIN s b ON a.vec_id = b.vec_id AND a.component = b.component AND a.x2 = b.x AND a.y2 = b.y
  QUALIFY row_number() OVER (PARTITION BY a.vec_id, a.component, a.id ORDER BY (5 + a.way - b.way) % 4) = 1
), walk AS (
  SELECT vec_id, component, id AS start, id, 0 AS step FROM s
  UNION ALL SELECT w.vec_id, w.component, w.start, n.follows, w.step + 1 FROM walk w JOIN nxt n ON w.vec_id = n.vec_id AND w.component = n.component AND w.id = n.id WHERE n.follows <> w.start
), ring AS (  -- the walk from the first side of each ring, where it turns
  SELECT w.*, s.x, s.y, s.size, s.way, lag(s.way) OVER o AS came, first_value(s.way) OVER o AS first_way FROM walk w JOIN s ON w.vec_id = s.vec_id AND w.component = s.component AND w.id = s.id
  WHERE (w.vec_id, w.component, w.start) IN (SELECT (vec_id, component, start) FROM walk GROUP BY vec_id, component, start HAVING min(id) = start)
  WINDOW o AS (PARTITION BY w.vec_id, w.component, w.start ORDER BY step)
), corner AS (SELECT * FROM ring WHERE came IS NULL OR came <> way
), placed AS (SELECT *, (vec_id * 31) % 4096 * size - {_EDGE!r}::DOUBLE AS west, {_EDGE!r}::DOUBLE - (vec_id * 17) % 4096 * size AS north FROM corner
), g AS (
  SELECT vec_id, component, start, step, degrees((west + x * (size / 8)) / {_R}::DOUBLE) AS lon, degrees(west / {_R}::DOUBLE) AS w, degrees((west + size) / {_R}::DOUBLE) AS e,
    degrees(2 * atan(exp((north - y * (size / 8)) / {_R}::DOUBLE)) - pi() / 2) AS lat, degrees(2 * atan(exp((north - size) / {_R}::DOUBLE)) - pi() / 2) AS s, degrees(2 * atan(exp(north / {_R}::DOUBLE)) - pi() / 2) AS n FROM placed
), q AS (SELECT vec_id, component, start, step, round((lon - w) / (e - w) * 4096)::INT AS x, 4096 - round((lat - s) / (n - s) * 4096)::INT AS y FROM g
), delta AS (  -- shells begin at the first corner of all, so rings by their start have the shell first
  SELECT *, x - lag(x, 1, 0) OVER w AS dx, y - lag(y, 1, 0) OVER w AS dy, row_number() OVER r AS at_ring, count(*) OVER (PARTITION BY vec_id, component, start) AS corners FROM q
  WINDOW w AS (PARTITION BY vec_id, component ORDER BY start, step), r AS (PARTITION BY vec_id, component, start ORDER BY step)
), z AS (SELECT *, CASE WHEN dx >= 0 THEN dx * 2 ELSE -dx * 2 - 1 END AS zx, CASE WHEN dy >= 0 THEN dy * 2 ELSE -dy * 2 - 1 END AS zy FROM delta)
SELECT vec_id, component, 'building' AS layer, count(DISTINCT start)::INT AS n_rings,
  string_agg(CASE WHEN at_ring = 1 THEN '9 ' ELSE '' END || zx || ' ' || zy || CASE WHEN at_ring = 1 THEN ' ' || ((corners - 1) * 8 + 2) ELSE '' END || CASE WHEN at_ring = corners THEN ' 15' ELSE '' END, ' ' ORDER BY start, step) AS commands
FROM z GROUP BY vec_id, component""",
    "road_buffer": f"""WITH {catalogue._WAYS}, l AS (
  SELECT *, k % 50 AS aoi, CASE WHEN k % 3 = 0 AND z > 0 THEN z::DOUBLE WHEN k % 7 < 3 AND z % 4 > 0 THEN (z % 4) * 3.5::DOUBLE ELSE coalesce(({catalogue._WIDTHS})[highway], 4)::DOUBLE END AS width FROM w WHERE n >= 2 AND NOT (k % 2 = 0 AND n >= 4)
), f AS (SELECT aoi, arg_min((n - 1) / 2::DOUBLE, k) AS lat FROM l GROUP BY aoi
), h AS (SELECT l.*, width / 2 / (({geo.M_LAT}::DOUBLE + {geo.M_LON}::DOUBLE * greatest(0.001::DOUBLE, cos(radians(lat)))) * 0.5::DOUBLE) AS half FROM l JOIN f ON l.aoi = f.aoi
), s AS (SELECT k, half, n, unnest(range(n - 1)) AS i FROM h
), d AS (SELECT k, half, sqrt(pow((i + 1) % 3 - i % 3, 2) + 1) AS length FROM s)
SELECT k AS id, count(*)::BIGINT AS segments, round(max(half), 12) AS half_deg, round(sum(2 * half * length), 9) AS area FROM d GROUP BY k""",
    "valid_ways": f"""WITH {catalogue._WAYS}, c AS (SELECT k, n, unnest(range(n - 1)) AS i FROM w WHERE k % 11 <> 0 AND k % 2 = 0 AND n >= 4), e AS (  -- sides of rings of n - 1 corners
  SELECT k, n - 1 AS m, i, i % 3 AS x, i AS y, ((i + 1) % (n - 1)) % 3 AS x2, (i + 1) % (n - 1) AS y2 FROM c
), a AS (SELECT k, sum(x * y2 - x2 * y) AS area FROM e GROUP BY k), x AS (
  SELECT DISTINCT p.k FROM e p JOIN e q ON p.k = q.k AND q.i > p.i + 1 AND NOT (p.i = 0 AND q.i = p.m - 1)
  WHERE sign((p.x2 - p.x) * (q.y - p.y) - (p.y2 - p.y) * (q.x - p.x)) * sign((p.x2 - p.x) * (q.y2 - p.y) - (p.y2 - p.y) * (q.x2 - p.x)) <= 0
    AND sign((q.x2 - q.x) * (p.y - q.y) - (q.y2 - q.y) * (p.x - q.x)) * sign((q.x2 - q.x) * (p.y2 - q.y) - (q.y2 - q.y) * (p.x2 - q.x)) <= 0
    AND greatest(p.x, p.x2) >= least(q.x, q.x2) AND greatest(q.x, q.x2) >= least(p.x, p.x2) AND greatest(p.y, p.y2) >= least(q.y, q.y2) AND greatest(q.y, q.y2) >= least(p.y, p.y2)
)
SELECT k AS id, 'Polygon' AS kind FROM a WHERE area <> 0 AND k NOT IN (SELECT k FROM x) UNION ALL SELECT k, 'LineString' FROM w WHERE k % 11 <> 0 AND n >= 2 AND NOT (k % 2 = 0 AND n >= 4)""",
    "grid_affine": f"""WITH {_BOXES}, r AS (SELECT *, (e - w) / (n - s) AS r FROM x), z AS (
  SELECT *, CASE WHEN r >= 1 THEN 1024 ELSE greatest(1, round_even(1024 * r, 0)::INT) END AS out_w, CASE WHEN r >= 1 THEN greatest(1, round_even(1024 / r, 0)::INT) ELSE 1024 END AS out_h FROM r
) SELECT id, round((e - w) / out_w, 12) AS a, 0::DOUBLE AS b, round(w, 12) AS c, 0::DOUBLE AS d, round(-((n - s) / out_h), 12) AS e, round(n, 12) AS f FROM z""",
    "component_outlines": f"""WITH RECURSIVE {raster.H.SQL}, {raster._labelled("SELECT vec_id, i FROM px WHERE p >= 0.4")}, g AS (
  SELECT vec_id, component, i // 8 AS y, i % 8 AS x FROM lab
), o AS (  -- cells of the frame round the chip and those inside it that are not of the component
  SELECT s.vec_id, s.component, f.x, f.y FROM sz s, (SELECT a AS x, b AS y FROM (SELECT unnest(range(-1, 9)) AS a), (SELECT unnest(range(-1, 9)) AS b)) f
  WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.vec_id = s.vec_id AND g.component = s.component AND g.x = f.x AND g.y = f.y)
), u AS (
  SELECT vec_id, component, -1::BIGINT AS x, -1::BIGINT AS y FROM sz
  UNION SELECT o.vec_id, o.component, o.x, o.y FROM u JOIN o ON u.vec_id = o.vec_id AND u.component = o.component AND abs(u.x - o.x) <= 1 AND abs(u.y - o.y) <= 1
), fill AS (SELECT vec_id, component, 100 - count(*) AS filled FROM u GROUP BY ALL
), shut AS (SELECT * FROM o ANTI JOIN u USING (vec_id, component, x, y)
), hole AS (  -- cells that are shut in, from each to all that it reaches by sides and corners
  SELECT vec_id, component, x, y, x AS px, y AS py FROM shut
  UNION SELECT h.vec_id, h.component, h.x, h.y, s.x, s.y FROM hole h JOIN shut s ON h.vec_id = s.vec_id AND h.component = s.component AND abs(h.px - s.x) <= 1 AND abs(h.py - s.y) <= 1
), named AS (SELECT vec_id, component, x, y, min(py * 8 + px) AS name FROM hole GROUP BY ALL
), sized AS (SELECT vec_id, component, name, count(*) AS n FROM named GROUP BY ALL), holes AS (SELECT vec_id, component, count(*) AS holes, max(n) AS largest FROM sized GROUP BY ALL)
SELECT sz.vec_id, sz.component, sz.n::BIGINT AS area, fill.filled::BIGINT AS filled, coalesce(holes, 0)::BIGINT AS holes, coalesce(largest, 0)::BIGINT AS largest_hole
FROM sz JOIN fill ON sz.vec_id = fill.vec_id AND sz.component = fill.component LEFT JOIN holes h ON sz.vec_id = h.vec_id AND sz.component = h.component""",
    "road_shapes": f"""WITH {catalogue._WAYS}, l AS (SELECT k, n, 0.05::DOUBLE + k % 4 * 0.05::DOUBLE AS half FROM w WHERE n >= 2 AND NOT (k % 2 = 0 AND n >= 4)
), s AS (SELECT k, half, unnest(range(n - 1)) AS i FROM l), d AS (SELECT k, half, i, ((i + 1) % 3 - i % 3)::DOUBLE AS dx, 1::DOUBLE AS dy FROM s
), t AS (SELECT *, lead(dx) OVER (PARTITION BY k ORDER BY i) AS ex, 1::DOUBLE AS ey FROM d
), b AS (SELECT *, abs(atan2(dx * ey - dy * ex, dx * ex + dy * ey)) AS turn FROM t
), j AS (SELECT *, greatest(1, ceil(turn / (pi() / 2) * 16 - 1e-9::DOUBLE)) AS m FROM b)
SELECT k AS id, round(any_value(half), 9) AS half, round(sum(2 * half * sqrt(dx * dx + dy * dy)) + sum(CASE WHEN turn > 0 THEN half * half * (m / 2 * sin(turn / m) - tan(turn / 2)) ELSE 0 END), 9) AS area, 1 AS rings FROM j GROUP BY k""",
}
