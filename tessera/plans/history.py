"""Queries on training histories, caches, sinks and the stand-in classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import history as T
from tessera.operators import pixel_model, training
from tessera.plans import catalogue, chips, raster
from tessera.sources import leases, reports
from tessera.sources.scratch import shared_folder

BATCH = 4


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.epochs(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("run"), "ts", "event_id", "value"), "run", ["ts", "event_id"], BATCH)


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs of a run; every third has no validation."""
    val = F.when(F.col("epoch") % 3 != 2, F.round(F.max("value") % 1, 9))
    return _steps(spark, sf_dir).groupBy("run", "epoch").agg(F.round(F.coalesce(F.avg("value"), F.lit(float("nan"))), 9).alias("train_loss_mean"), val.alias("val_iou"), F.count(F.lit(1)).alias("batches"))


def epoch_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir)


def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.best_epoch(_history(spark, sf_dir), "run")


def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.running_best(_history(spark, sf_dir), "run").select("run", "epoch", "improved")


def masked_mean_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = (F.col("event_id") % 3 != 0).cast("int")
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("run")).agg(F.round(T.masked_mean(F.col("value"), valid), 9).alias("loss"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 500).alias("aoi"), F.lit(1024).alias("side"), "o_orderkey")
    return orders.withColumn("key", T.cache_key(F.lit("hotosm"), F.col("aoi"), max_side=F.col("side"), dst_crs=F.lit("EPSG:3857")))


def cache_miss_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _requests(spark, sf_dir)
    cached = requests.where("aoi % 3 = 0").select("key").distinct()
    return T.misses(requests, cached).select("key", "aoi")


def cache_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _requests(spark, sf_dir)
    cached = requests.where("aoi % 3 = 0").select("key", "aoi").distinct().withColumn("filled", F.lit(False))
    return T.fill(requests, cached, lambda missing: missing.select("key", "aoi", F.lit(True).alias("filled"))).groupBy("filled").agg(F.count(F.lit(1)).alias("n"), F.sum("aoi").alias("aois"))


def leased_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fills of a keyed table, the second asking for the keys of the first and more: which one fetched each key."""
    requests = _requests(spark, sf_dir).select("key", "aoi").distinct()
    path = shared_folder(spark, "cache")
    for number, part in enumerate((requests.where("aoi % 3 = 0"), requests), 1):
        rows = leases.fill_once(part, path, "imagery", lambda missing, n=number: missing.select("key", "aoi", F.lit(n).alias("fill_number")))
    return rows.select("key", "aoi", "fill_number")


def geojson_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature of each way as GeoJSON text, closed ways as polygons."""
    ways = catalogue.ways(spark, sf_dir).withColumn("kind", catalogue.K.way_kind(F.col("coords"))).where("type = 'way' AND kind IS NOT NULL")
    line = F.transform("coords", lambda c: F.array(c["lon"], c["lat"]))
    return ways.select("id", geojson_feature(F.col("kind"), line).alias("feature"))


def geojson_feature(kind, line):
    """A GeoJSON feature without properties from a kind and its corners."""
    text = F.to_json(line)
    return F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), kind, F.lit('","coordinates":'), F.when(kind == "Polygon", F.concat(F.lit("["), text, F.lit("]"))).otherwise(text), F.lit('},"properties":{}}'))


def pixel_classifier_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in model: a logistic regression on a pixel and its neighbourhood, with validity as weight.

    It is fitted on the even chips and predicts all; ``fitted`` says which chips it has seen.
    """
    px = pixel_model.features(chips.chips(spark, sf_dir), chips.SIDE).withColumn("fitted", F.col("vec_id") % 2 == 0)
    return pixel_model.predict(pixel_model.fit(px.where("fitted")), px).select("vec_id", "i", F.round("p", 6).alias("p"), "fitted")


def trained(spark: SparkSession, sf_dir: str, settings: training.Settings = training.Settings()) -> training.State:  # noqa: B008
    """A network trained on the even chips, with the odd ones for validation."""
    chip = chips.chips(spark, sf_dir).select("vec_id", "px")
    return training.train(chip.where("vec_id % 2 = 0"), chip.where("vec_id % 2 = 1"), chips.SIDE, shared_folder(spark, "training"), settings)


def training_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The epochs of a training in mini-batches, with the lines that report them."""
    rows = training.history(spark, trained(spark, sf_dir))
    told = reports.epoch_lines(rows, "train_loss_mean", "val_iou", "val_f1", "best")
    rounded = [F.round(c, 6).alias(c) for c in ("train_loss_mean", "val_iou", "val_f1")]
    return told.select("epoch", *rounded, "best", "line")


def history_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many epochs each run's report has, which one is best, and which were kept because they improved."""
    rows = _history(spark, sf_dir)
    told = T.running_best(rows, "run").join(T.best_epoch(rows, "run").select("run", "best_epoch"), "run")
    kind = "struct<best_epoch:long,kept_epochs:array<long>,history:array<struct<epoch:long,train_loss_mean:double,val_iou:double>>>"
    report = reports.history_report(told, "run").select("run", F.from_json("report", kind).alias("r"))
    return report.select("run", F.size("r.history").cast("long").alias("epochs"), "r.best_epoch", F.array_join(F.col("r.kept_epochs").cast("array<string>"), ",").alias("kept"))


def inference_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of each chip's metadata, read back from its JSON."""
    v = F.col("vec_id")
    rows = raster.inference_report(spark, sf_dir).select(
        v.alias("aoi_index"), (v % 360 - 180.0).alias("w"), (v % 90 * 1.0).alias("s"), (v % 360 - 179.5).alias("e"), (v % 90 + 0.5).alias("n"), F.lit("").alias("region"), F.lit("").alias("notes"), F.lit(0.6).alias("threshold"),
        F.lit(raster.MIN_AREA_M2).alias("area_filter_m2"), "iou", "f1", F.col("pred_polys").alias("n_pred_polys"), F.col("gt_pixels").alias("n_gt_pixels"), F.col("pred_pixels").alias("n_pred_pixels"),
        F.col("valid_pixels").alias("n_valid_pixels"), F.col("total_pixels").alias("n_total_pixels"), "valid_fraction", F.lit(raster.PIXEL_M2).alias("pixel_area_m2"),
    )
    told = reports.metadata(rows)
    get = lambda name: F.get_json_object("metadata", f"$.{name}")
    fields = F.array_join(F.json_object_keys("metadata"), ",")
    return told.select("aoi_index", fields.alias("fields"), get("bbox").alias("bbox"), F.round(get("iou").cast("double"), 9).alias("iou"), get("n_gt_pixels").cast("long").alias("n_gt_pixels"), get("n_pred_polys").cast("long").alias("n_pred_polys"), get("threshold").cast("double").alias("threshold"))


QUERIES = {f.__name__: f for f in (history_reports, inference_metadata, epoch_history, best_epoch, running_best, masked_mean_loss, cache_miss_plan, cache_fill, leased_fill, geojson_sink, pixel_classifier_probabilities, training_history)}

_HISTORY = """s AS (SELECT user_id AS run, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4 AS epoch FROM events), h AS (
  SELECT run, epoch, round(avg(value), 9) AS train_loss_mean, CASE WHEN epoch % 3 <> 2 THEN round(max(value) % 1, 9) END AS val_iou, count(*)::BIGINT AS batches FROM s GROUP BY run, epoch
)"""
_KEY = "substr(sha256('hotosm|' || aoi || '|dst_crs=EPSG:3857|max_side=1024'), 1, 32)"
_REQUESTS = f"r AS (SELECT DISTINCT o_custkey % 500 AS aoi FROM orders), k AS (SELECT aoi, {_KEY} AS key FROM r)"
SQL = {
    "history_reports": f"""WITH {_HISTORY}, i AS (SELECT run, epoch, val_iou, coalesce(val_iou > coalesce(max(val_iou) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), false) AS improved FROM h)
SELECT run, count(*)::BIGINT AS epochs, coalesce(arg_max(epoch, (val_iou, -epoch)) FILTER (val_iou > -1), max(epoch)) AS best_epoch, coalesce(string_agg(epoch::VARCHAR, ',' ORDER BY epoch) FILTER (improved), '') AS kept FROM i GROUP BY run""",
    "inference_metadata": f"""WITH r AS ({raster.SQL["inference_report"]})
SELECT vec_id AS aoi_index, '{",".join(reports.METADATA)}' AS fields, '[' || (vec_id % 360 - 180.0::DOUBLE) || ',' || (vec_id % 90)::DOUBLE || ',' || (vec_id % 360 - 179.5::DOUBLE) || ',' || (vec_id % 90 + 0.5::DOUBLE) || ']' AS bbox, round(iou, 9) AS iou, gt_pixels AS n_gt_pixels, pred_polys AS n_pred_polys, 0.6::DOUBLE AS threshold FROM r""",
    "epoch_history": f"WITH {_HISTORY} SELECT * FROM h",
    "best_epoch": f"""WITH {_HISTORY}
SELECT run, coalesce(arg_max(epoch, (val_iou, -epoch)) FILTER (val_iou > -1), max(epoch)) AS best_epoch, max(val_iou) FILTER (val_iou > -1) AS best_val_iou FROM h GROUP BY run""",
    "running_best": f"WITH {_HISTORY} SELECT run, epoch, coalesce(val_iou > coalesce(max(val_iou) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), false) AS improved FROM h",
    "geojson_sink": f"""WITH {catalogue._WAYS}, c AS (SELECT k, k % 2 = 0 AND n >= 4 AS closed, n, unnest(range(n)) AS i FROM w WHERE k % 11 <> 0 AND n >= 2), p AS (
  SELECT k, any_value(closed) AS closed, to_json(list([(k % 10 + j % 3)::DOUBLE, j::DOUBLE] ORDER BY i)) AS line FROM (SELECT *, CASE WHEN closed AND i = n - 1 THEN 0 ELSE i END AS j FROM c) GROUP BY k
) SELECT k AS id, '{{"type":"Feature","geometry":{{"type":"' || CASE WHEN closed THEN 'Polygon","coordinates":[' || line || ']' ELSE 'LineString","coordinates":' || line END || '}},"properties":{{}}}}' AS feature FROM p""",
    "masked_mean_loss": "SELECT user_id AS run, round(sum(value * (event_id % 3 <> 0)::INT) / greatest(sum((event_id % 3 <> 0)::INT), 1), 9) AS loss FROM events GROUP BY user_id",
    "cache_miss_plan": f"WITH {_REQUESTS} SELECT key, aoi FROM k WHERE aoi % 3 <> 0",
    "leased_fill": f"WITH {_REQUESTS} SELECT key, aoi, CASE WHEN aoi % 3 = 0 THEN 1 ELSE 2 END AS fill_number FROM k",
    "cache_fill": f"WITH {_REQUESTS} SELECT aoi % 3 <> 0 AS filled, count(*)::BIGINT AS n, sum(aoi)::BIGINT AS aois FROM k GROUP BY 1",
}
