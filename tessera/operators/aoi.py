"""Areas of interest: train and validation splits, checks, scores, leakage between splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.functions.figures import figure, told

MIN_VALID_FRACTION, FULL_VALID_FRACTION = 0.5, 1.0
DENSITY_LOW, DENSITY_HIGH = 100.0, 2000.0
MIN_DISTANCE_M = 200.0
#: Areas of one place that go together into pairs with those of another.
RUN = 1024
#: The texts of reasons and warnings.
LOW_VALID = "valid_pixel_fraction %s < threshold %s"
FEW_POLYGONS = "polygon_count %s < feature.min_positive_polygon_count %s"
FEW_PIXELS = "positive_pixel_fraction %s < feature.min_positive_pixel_fraction %s"
SPARSE = "polygon_density_per_km2 %s is low (rural? sparse OSM?)"
DENSE = "polygon_density_per_km2 %s is ultra-dense; IoU will be bound by polygon boundary noise"
FETCH_FAILED = "imagery fetch failed: %s"
SOME_UNTAGGED = "some AOIs lack phenotype tag (others = [%s]); recommend tagging all AOIs"


def explicit_val(holdout: Column, region: Column, val_regions: tuple[str, ...]) -> Column:
    return holdout | region.isin(*val_regions) if val_regions else holdout


def split(aois: DataFrame, recipe: str, val_regions: tuple[str, ...] = ()) -> DataFrame:
    """``aois`` with ``split``: val where explicit; a recipe without any such area gives its last one (of two or more) to val."""
    explicit = explicit_val(F.col("holdout"), F.col("region"), val_regions)
    facts = aois.groupBy(F.col(recipe).alias("of_recipe")).agg(F.bool_or(explicit).alias("any_val"), F.count(F.lit(1)).alias("n_aois"), F.max("aoi_index").alias("last"))
    last = ~F.col("any_val") & (F.col("n_aois") > 1) & (F.col("aoi_index") == F.col("last"))
    return aois.join(facts, F.col(recipe) == F.col("of_recipe")).withColumn("split", F.when(explicit | last, "val").otherwise("train")).drop("of_recipe", "any_val", "n_aois", "last")


def close_places(train: DataFrame, val: DataFrame, max_m: float = MIN_DISTANCE_M, by: tuple[str, ...] = ()) -> DataFrame:
    """(lon, lat, n, val_lon, val_lat, val_n, metres, by...) of places closer than ``max_m`` that agree in ``by``, with the areas at each; inputs are (lon, lat, by...).

    Both sides are dealt by cells as wide as the distance, a val place to its own and all eight cells
    around, so that pairs meet by equality. Cells widen with the latitude (of the cell's row, towards
    the pole), and those of one row are counted from the west. A val place is dealt on the other side of the
    180th meridian as well.
    """
    d_lat = max_m / (geo.EARTH_M * 3.14159265358979 / 180)
    row = lambda lat: F.floor(lat / d_lat)
    width = lambda r: d_lat / F.greatest(F.lit(1e-6), F.cos(F.radians(F.least(F.lit(89.9), (F.abs(r) + 2) * d_lat))))
    place = lambda rows: rows.groupBy("lon", "lat", *by).agg(F.count(F.lit(1)).alias("n"))
    left = place(train).withColumn("r", row(F.col("lat"))).withColumn("c", F.floor(F.col("lon") / width(F.col("r"))))
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    right = place(val).withColumn("x", F.explode(F.array(*[F.col("lon") + d for d in (-360.0, 0.0, 360.0)]))).where(F.abs("x") <= 270)
    right = right.withColumn("dr", near).withColumn("r", row(F.col("lat")) + F.col("dr")).withColumn("dc", near).withColumn("c", F.floor(F.col("x") / width(F.col("r"))) + F.col("dc"))
    right = right.select(F.col("lon").alias("val_lon"), F.col("lat").alias("val_lat"), F.col("n").alias("val_n"), "r", "c", *by)
    metres = geo.haversine_m(F.col("lon"), F.col("lat"), F.col("val_lon"), F.col("val_lat"))
    return left.join(right, ["r", "c", *by]).select("lon", "lat", "n", "val_lon", "val_lat", "val_n", metres.alias("metres"), *by).where(F.col("metres") < max_m)


def close_pairs(train: DataFrame, val: DataFrame, max_m: float = MIN_DISTANCE_M, by: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """(train, val, metres, by...) of pairs closer than ``max_m`` that agree in ``by``; inputs are (aoi_index, lon, lat, by...).

    ``digits`` rounds the metres of the result. Places meet first (``close_places``), so that a distance is worked out once for all areas at two places. The areas
    at a place come in runs of some ``RUN``; pairs of runs are dealt evenly and only then become pairs of areas.
    """

    def runs(rows: DataFrame, name: str) -> DataFrame:
        at = ["lon", "lat", *by]
        n = rows.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / RUN).alias("n_runs"))
        run = F.when(F.col("n_runs") > 1, F.pmod(F.xxhash64("aoi_index"), F.col("n_runs"))).otherwise(0)
        return rows.join(n, at).groupBy(*at, run.alias("run")).agg(F.collect_list("aoi_index").alias(name)).drop("run")

    places = close_places(train, val, max_m, by).withColumn("metres", F.col("metres") if digits is None else F.round("metres", digits))
    met = places.drop("n", "val_n").join(runs(train, "trains"), ["lon", "lat", *by]).drop("lon", "lat")
    met = met.join(runs(val, "vals").withColumnsRenamed({"lon": "val_lon", "lat": "val_lat"}), ["val_lon", "val_lat", *by]).select("trains", "vals", "metres", *by)
    dealt = met.repartition(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.select(F.explode("trains").alias("train"), "vals", "metres", *by).select("train", F.explode("vals").alias("val"), "metres", *by)


def soft_valid(v: Column) -> Column:
    return F.when(v <= MIN_VALID_FRACTION, 0.0).when(v >= FULL_VALID_FRACTION, 1.0).otherwise((v - MIN_VALID_FRACTION) / (FULL_VALID_FRACTION - MIN_VALID_FRACTION))


def check(facts: DataFrame) -> DataFrame:
    """Checks areas from (w, s, e, n, valid_fraction, n_polygons, pixel_fraction, min_count, min_fraction, min_valid, fetch_error).

    An area whose imagery failed fails with that reason alone and has no further facts. A failed
    truth is a warning, with the counts that were reached. Reasons and warnings tell the figure and its
    limit, rounded to even in the last place.
    """
    v, n, f = F.col("valid_fraction"), F.col("n_polygons"), F.col("pixel_fraction")
    area = geo.bbox_area_km2(F.col("w"), F.col("s"), F.col("e"), F.col("n"))
    density = F.when(area > 0, n / F.when(area > 0, area).otherwise(1.0)).otherwise(0.0)
    some = lambda *x: F.filter(F.array(*x), lambda y: y.isNotNull())
    failed = F.col("fetch_error").isNotNull()
    reasons = some(
        F.when(v < F.col("min_valid"), told(LOW_VALID, figure(v, 3), F.col("min_valid"))),
        F.when((F.col("min_count") > 0) & (n < F.col("min_count")), told(FEW_POLYGONS, n, F.col("min_count"))),
        F.when((F.col("min_fraction") > 0) & (f < F.col("min_fraction")), told(FEW_PIXELS, figure(f, 4), F.col("min_fraction"))),
    )
    warnings = some(F.when((density > 0) & (density < DENSITY_LOW), told(SPARSE, figure(density, 0))), F.when(density > DENSITY_HIGH, told(DENSE, figure(density, 0))))
    soft = F.create_map(
        F.lit("valid_fraction"), soft_valid(v),
        F.lit("polygon_count"), F.when(F.col("min_count") > 0, F.least(F.lit(1.0), n / F.greatest(F.col("min_count") * 5, F.lit(1)))).otherwise(1.0),
        F.lit("pixel_fraction"), F.when(F.col("min_fraction") > 0, F.least(F.lit(1.0), f / F.greatest(F.col("min_fraction") * 3.0, F.lit(0.01)))).otherwise(1.0),
    )
    checked = facts.withColumns({"area_km2": area, "density": F.when(failed, 0.0).otherwise(density), "reasons": F.when(failed, F.array(told(FETCH_FAILED, F.col("fetch_error")))).otherwise(reasons)})
    checked = checked.withColumns({"warnings": F.when(failed, F.array().cast("array<string>")).otherwise(warnings), "hard_pass": F.size("reasons") == 0, "soft": F.when(failed, F.create_map().cast("map<string,double>")).otherwise(soft)})
    mean = F.aggregate(F.map_values("soft"), F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size("soft"), F.lit(1))
    return checked.withColumn("quality", mean)


def notes(reasons: Column, warnings: Column) -> Column:
    """The first reason and the first warning, forty characters at most."""
    return F.substring(F.array_join(F.concat(F.slice(reasons, 1, 1), F.slice(warnings, 1, 1)), "; "), 1, 40)


def ranked(rows: DataFrame, partition: str, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(partition).orderBy(*order)))


def untagged_warning(kinds: Column) -> Column:
    """The warning about areas without a phenotype beside others of ``kinds``, a sorted array."""
    quoted = F.array_join(F.transform(kinds, lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", ")
    return told(SOME_UNTAGGED, quoted)


def first_only(aois: DataFrame, recipe: str) -> DataFrame:
    """The first area of each recipe, for smoke runs."""
    return ranked(aois, recipe, F.col("aoi_index")).where(F.col("rank") == 1).drop("rank")


def all_but_last(aois: DataFrame, recipe: str) -> DataFrame:
    """All areas of a recipe but its last one; a single area has none before it."""
    return ranked(aois, recipe, F.desc("aoi_index")).where(F.col("rank") > 1).drop("rank")


def tile_status(feature: Column, z: Column, features: list[str], loaded: list[str], least_zoom: int = 15) -> Column:
    """What a tile request gets: empty below the least zoom, 404 for an unknown feature, 503 where its model isn't loaded, else 200."""
    return F.when(z < least_zoom, "empty").when(~feature.isin(*features), "404").when(~feature.isin(*loaded), "503").otherwise("200")
