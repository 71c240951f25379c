"""Imagery catalogues and map features: parsing of items and ways, choices among them, road widths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.aoi import ranked

#: Road widths in metres by class, as the results need them.
ROAD_WIDTHS_M = {
    "motorway": 12.0, "motorway_link": 8.0, "trunk": 10.0, "trunk_link": 7.0, "primary": 8.0, "primary_link": 6.0, "secondary": 7.0,
    "secondary_link": 5.0, "tertiary": 6.0, "tertiary_link": 4.0, "unclassified": 5.0, "residential": 5.0, "living_street": 4.0, "service": 3.5,
}
DEFAULT_WIDTH_M, LANE_M = 4.0, 3.5


def is_dsm(instruments: Column, title: Column) -> Column:
    """Elevation products: DSM in an instrument or in the title, in capitals."""
    return F.coalesce(F.exists(instruments, lambda i: F.contains(i, F.lit("DSM"))), F.lit(False)) | F.coalesce(F.contains(title, F.lit("DSM")), F.lit(False))


def asset_href(assets: Column) -> Column:
    """The image of an item: the asset ``visual``, else the first whose media type names a GeoTIFF; its http(s)
    address, else the first such alternate, else the address as it is."""
    values = F.map_values(assets)
    tiff = F.filter(values, lambda a: F.coalesce(F.lower(a["type"]).rlike("cloud-optimized|geotiff"), F.lit(False)))
    asset = F.coalesce(F.try_element_at(assets, F.lit("visual")), F.get(tiff, F.lit(0)))
    web = lambda h: F.coalesce(h.rlike("^https?://"), F.lit(False))
    other = F.filter(F.map_values(asset["alternate"]), lambda a: web(a["href"]))
    return F.when(web(asset["href"]), asset["href"]).otherwise(F.coalesce(F.get(other, F.lit(0))["href"], asset["href"]))


def usable(bands: Column, dtypes: Column) -> Column:
    return (bands >= 3) & F.forall(F.slice(dtypes, 1, 3), lambda d: d == "uint8")


def candidates(items: DataFrame) -> DataFrame:
    """Items (aoi_index, pos, id, bbox, datetime, instruments, title, assets) that can serve, ranked newest first, then in their order."""
    kept = items.withColumn("href", asset_href(F.col("assets"))).where(~is_dsm(F.col("instruments"), F.col("title")) & F.col("href").isNotNull() & (F.col("href") != "") & (F.size("bbox") == 4))
    return ranked(kept, "aoi_index", F.coalesce("datetime", F.lit("")).desc(), F.col("pos"))


def first_usable(ranked_items: DataFrame) -> DataFrame:
    """The first usable item of each area by rank; one aggregation, no sort."""
    ok = usable(F.col("bands"), F.col("dtypes"))
    return ranked_items.groupBy("aoi_index").agg(F.min_by(F.struct("id", "href"), F.when(ok, F.col("rank"))).alias("x"), F.count_if(~ok).alias("rejected")).select("aoi_index", "x.*", "rejected")


def datetime_digits(text: Column) -> Column:
    """The first 14 digits of a timestamp as a number; 0 for none."""
    return F.coalesce(F.substring(F.translate(text, "-:TZ ", ""), 1, 14).try_cast("long"), F.lit(0).cast("long"))


def cloud_then_newest(items: DataFrame) -> DataFrame:
    return ranked(items, "aoi_index", F.coalesce("cloud_cover", F.lit(100.0)), datetime_digits(F.col("datetime")).desc(), F.col("pos"))


def gdal_path(url: Column) -> Column:
    return F.when(url.rlike("^https?://"), F.concat(F.lit("/vsicurl/"), url)).otherwise(url)


def way_kind(coords: Column) -> Column:
    """Polygon for a closed way of four corners or more, else LineString; null below two corners."""
    closed = (F.size(coords) >= 4) & (F.get(coords, F.lit(0)) == F.try_element_at(coords, F.lit(-1)))
    return F.when(F.size(coords) >= 2, F.when(closed, "Polygon").otherwise("LineString"))


@dataclass(frozen=True)
class FeatureSpec:
    """A feature by its tags: one of the keys with any value (None) or with one of the values."""

    name: str
    tags: tuple[tuple[str, tuple[str, ...] | None], ...]

    def holds(self, tags: dict[str, str]) -> bool:
        return any(tags.get(k) is not None if values is None else tags.get(k) in values for k, values in self.tags)

    def predicate(self, tags: Column) -> Column:
        test = F.lit(False)
        for key, values in self.tags:
            test = test | F.coalesce(tags[key].isNotNull() if values is None else tags[key].isin(*values), F.lit(False))
        return test


#: The tags of features.
FEATURES = {
    s.name: s
    for s in (
        FeatureSpec("building", (("building", None),)),
        FeatureSpec("park", (("leisure", ("park",)), ("landuse", ("recreation_ground",)))),
        FeatureSpec("parking", (("amenity", ("parking",)), ("parking", ("surface",)))),
        FeatureSpec("road", (("highway", tuple(ROAD_WIDTHS_M)),)),
    )
}


def feature_predicate(feature: str, tags: Column) -> Column:
    return FEATURES[feature].predicate(tags)


def width_m(tags: Column) -> Column:
    """Width of a road: its width tag, else its lanes, else its class, else a default; only positive numbers count."""
    head = F.rtrim(F.get(F.split(F.trim(tags["width"]), r"\s+"), F.lit(0)), F.lit("m")).try_cast("double")
    width = F.when((head > 0) & ~F.isnan(head), head)
    lanes = F.trim(F.get(F.split(tags["lanes"], ";"), F.lit(0))).try_cast("int")
    table = F.create_map(*[F.lit(x) for pair in ROAD_WIDTHS_M.items() for x in pair])
    return F.coalesce(width, F.when(lanes > 0, lanes * LANE_M), table[tags["highway"]], F.lit(DEFAULT_WIDTH_M))
