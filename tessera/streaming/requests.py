"""Checks of areas as their requests arrive: a file stream of facts through the same checks as the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import aoi

FACTS = """aoi_index long, w double, s double, e double, n double, valid_fraction double, n_polygons int, pixel_fraction double,
  min_count int, min_fraction double, min_valid double, fetch_error string"""


def requests(spark: SparkSession, path: str, files_each: int = 100) -> DataFrame:
    return spark.readStream.schema(FACTS).option("maxFilesPerTrigger", files_each).json(path)


def check_stream(facts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes a row for each request, exactly once; stateless, so nothing grows. Ends when what is there is done."""
    checked = aoi.check(facts).drop("soft")
    return checked.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
