"""Sinks: keyed tables, JSON reports, GeoJSON. Writers commit their output as Spark does, so readers never see halves."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_cache(rows: DataFrame, path: str, namespace: str, key: str = "key") -> None:
    """Adds one row for each key that the keyed table of a namespace lacks.

    Fills that run at once may both add a key; the rows carry when they were filled, and readers take
    the first.
    """
    spark = rows.sparkSession
    new = rows.dropDuplicates([key])
    try:
        new = new.join(spark.read.parquet(path).where(F.col("namespace") == namespace).select(key), key, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    new.withColumn("filled_at", F.current_timestamp()).withColumn("namespace", F.lit(namespace)).write.mode("append").partitionBy("namespace").parquet(path)


def read_cache(spark: SparkSession, path: str, namespace: str, key: str = "key") -> DataFrame:
    """One row for each key of a namespace, the first that was filled; only its folder is read."""
    found = spark.read.parquet(path).where(F.col("namespace") == namespace)
    others = [c for c in found.columns if c not in (key, "filled_at", "namespace")]
    first = found.groupBy(key).agg(F.min_by(F.struct(*others), F.struct("filled_at", F.xxhash64(*others))).alias("first"))
    return first.select(key, *[F.col("first")[c].alias(c) for c in others])


def write_images(rows: DataFrame, path: str, namespace: str, key: str = "key") -> None:
    """Caches images: (key, bands array, valid array or null, height, width, meta...). Validity has a column of its own, of the image's size."""
    size = F.col("height") * F.col("width")
    fits = (F.size("bands") % size == 0) & (F.col("valid").isNull() | (F.size("valid") == size))
    checked = rows.withColumn("bands", F.when(fits, F.col("bands")).otherwise(F.raise_error(F.concat(F.lit("bands or validity of another size: "), F.col(key))).cast(rows.schema["bands"].dataType)))
    write_cache(checked, path, namespace, key)


def write_polygons(rows: DataFrame, path: str, namespace: str, key: str = "key") -> None:
    """Caches polygons: (key, polygons array of GeoJSON geometries); null geometries are left out."""
    write_cache(rows.withColumn("polygons", F.filter("polygons", lambda g: g.isNotNull())), path, namespace, key)


def write_json(rows: DataFrame, path: str) -> None:
    """Reports (thresholds, grids, histories) as JSON lines."""
    rows.write.mode("overwrite").json(path)


def write_geojson(features: DataFrame, path: str, column: str = "feature") -> None:
    """GeoJSON text sequences: a feature a line, so that no collection gathers in one task."""
    features.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
