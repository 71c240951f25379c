"""Geometry of boxes, tiles and Web-Mercator as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
MERCATOR_M = 6_378_137.0
#: Kilometres a degree, as areas of boxes take them.
KM_LON, KM_LAT = 111.32, 110.57
#: Metres a degree, as road buffers take them.
M_LON, M_LAT = 111_320.0, 110_540.0


def bbox_area_km2(w: Column, s: Column, e: Column, n: Column) -> Column:
    return F.greatest(F.lit(0.0), (e - w) * KM_LON * F.cos(F.radians((s + n) / 2.0)) * ((n - s) * KM_LAT))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(a))


def pixel_area_m2(pixel_w: Column, pixel_h: Column, crs: Column, s: Column, n: Column) -> Column:
    """The area of a pixel; Web-Mercator metres shrink by the cosine of the latitude in both directions."""
    flat = F.abs(pixel_w * pixel_h)
    cos = F.cos(F.radians((s + n) / 2.0))
    return F.when(F.replace(F.upper(crs), F.lit(" "), F.lit("")) == "EPSG:3857", flat * cos * cos).otherwise(flat)


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * MERCATOR_M


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MERCATOR_M


def lon_of(x: Column) -> Column:
    return F.degrees(x / MERCATOR_M)


def lat_of(y: Column) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(F.exp(y / MERCATOR_M)) - math.pi / 2)


def tile_size_m(z: Column) -> Column:
    return F.lit(2 * math.pi * MERCATOR_M) / F.pow(F.lit(2.0), z)


def tile_bounds(z: Column, x: Column, y: Column) -> dict[str, Column]:
    """West, south, east and north of a tile in Web-Mercator metres; tile rows run southwards."""
    size, edge = tile_size_m(z), F.lit(math.pi * MERCATOR_M)
    return {"west": x * size - edge, "south": edge - (y + 1) * size, "east": (x + 1) * size - edge, "north": edge - y * size}


def output_size(w: Column, h: Column, longest: int) -> tuple[Column, Column]:
    """(width, height) with the longer side ``longest`` and the other rounded half to even, 1 at least.

    A box without extent is an error.
    """
    ratio = F.when((w <= 0) | (h <= 0), F.raise_error(F.lit("degenerate bbox")).cast("double")).otherwise(w / h)
    other = lambda r: F.greatest(F.lit(1), F.bround(r).cast("int"))
    return F.when(ratio >= 1, F.lit(longest)).otherwise(other(longest * ratio)), F.when(ratio >= 1, other(longest / ratio)).otherwise(F.lit(longest))


def affine(w: Column, s: Column, e: Column, n: Column, width: Column | int, height: Column | int) -> Column:
    """The transform (a, b, c, d, e, f) of a north-up grid of pixels in bounds: x = a col + b row + c, y = d col + e row + f."""
    px, py = (e - w) / width, (n - s) / height
    zero = F.lit(0.0)
    return F.struct(px.alias("a"), zero.alias("b"), w.cast("double").alias("c"), zero.alias("d"), (-py).alias("e"), n.cast("double").alias("f"))


def with_extent(box: Column) -> Column:
    """A box (w, s, e, n) as it is; one without extent is an error."""
    good = (box["w"] < box["e"]) & (box["s"] < box["n"])
    return F.when(good, box).otherwise(F.raise_error(F.lit("degenerate bbox")).cast("struct<w:double,s:double,e:double,n:double>"))


def parse_bbox(text: Column) -> Column:
    """A struct (w, s, e, n) from ``W,S,E,N``; anything else, and a box without extent, is an error."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))
    good = (F.size(parts) == 4) & F.forall(parts, lambda x: x.isNotNull())
    box = F.struct(*[F.get(parts, F.lit(i)).alias(name) for i, name in enumerate("wsen")])
    return with_extent(F.when(good, box).otherwise(F.raise_error(F.concat(F.lit("not a bbox: "), text)).cast("struct<w:double,s:double,e:double,n:double>")))


def grid_cells(box: dict[str, Column], cols: int, rows: int) -> Column:
    """An array of cells from the south-west, columns inside rows, with names ``c{i}r{j}``."""
    dlon, dlat = (box["e"] - box["w"]) / cols, (box["n"] - box["s"]) / rows

    def cell(i: int, j: int) -> Column:
        w, s = box["w"] + i * dlon, box["s"] + j * dlat
        return F.struct(F.lit(f"c{i}r{j}").alias("name"), w.alias("w"), s.alias("s"), (w + dlon).alias("e"), (s + dlat).alias("n"))

    return F.array(*[cell(i, j) for j in range(rows) for i in range(cols)])


def quantize(value: Column, low: Column, high: Column, extent: int = 4096) -> Column:
    return F.round((value - low) / (high - low) * extent).cast("int")
