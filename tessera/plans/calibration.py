"""Queries on calibration: confusion, sweeps, best thresholds, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import metrics as M
from tessera.operators import calibration as C
from tessera.plans import chips as H
from tessera.sources import reports


def pixel_confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.confusion(H.chips(spark, sf_dir), lambda x: M.at_least(x["p"], 0.5)).drop("region")


def strict_threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.confusion(H.chips(spark, sf_dir), lambda x: M.above(x["p"], 0.5)).drop("region")


def threshold_sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sweep(H.chips(spark, sf_dir)).drop("region", "ordinal")


def best_threshold_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.best_thresholds(C.sweep(H.chips(spark, sf_dir))).drop("region")


def region_calibrated_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.by_region(C.best_thresholds(C.sweep(H.chips(spark, sf_dir))))


def region_calibrated_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.by_region(C.best_thresholds(C.sweep(H.chips(spark, sf_dir))), "best_f1")


def argmax_region_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.confusion(H.chips(spark, sf_dir), lambda x: M.class_one(1.0 - x["p"], x["p"]))
    of = lambda m: [F.round(F.avg(m), 9).alias(f"mean_{m}"), F.round(F.median(m), 9).alias(f"median_{m}"), F.min(m).alias(f"min_{m}")]
    return rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), *of("iou"), *of("f1"))


def dataset_mean_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.confusion(H.chips(spark, sf_dir), lambda x: M.at_least(x["p"], 0.5))
    return rows.agg(*[F.round(F.coalesce(F.avg(m), F.lit(0.0)), 9).alias(f"mean_{m}") for m in ("iou", "f1")])


def labelled_prediction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars")
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 0").join(docs, "doc_id")
    pred, target = F.col("n_chars") >= 1500, F.col("quality") == 1
    n = lambda test, name: F.count_if(test).alias(name)
    c = [F.col(x) for x in ("tp", "fp", "fn")]
    return (
        rows.groupBy(F.col("source").alias("region"))
        .agg(n(pred & target, "tp"), n(pred & ~target, "fp"), n(~pred & target, "fn"))
        .withColumns({"iou": M.iou(*c), "precision": M.precision(c[0], c[1]), "recall": M.precision(c[0], c[2]), "f1": M.f1(*c), "panel_f1": M.panel_f1(*c)})
    )


def region_metric_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("region"), "l_discount")
    return C.by_region(lines, "l_discount")


def region_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the report by region."""
    return reports.region_lines(argmax_region_metrics(spark, sf_dir), "mean_iou", "median_iou", "min_iou", "mean_f1")


def sweep_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each chip's best threshold, without area filter."""
    best = C.best_thresholds(C.sweep(H.chips(spark, sf_dir)))
    return reports.sweep_lines(best.withColumnRenamed("vec_id", "aoi_index").withColumn("best_area_filter_m2", F.lit(0.0)))


QUERIES = {f.__name__: f for f in (region_report_lines, sweep_report_lines, region_calibrated_summary, region_calibrated_f1, pixel_confusion_metrics, strict_threshold_metrics, threshold_sweep_grid, best_threshold_first_wins, argmax_region_metrics, dataset_mean_metrics, labelled_prediction_metrics, region_metric_quantiles)}


def counted(test: str) -> str:
    return f"""SELECT vec_id, any_value(region) AS region, (count(*) FILTER (valid = 1 AND {test} AND target = 1))::BIGINT AS tp,
  (count(*) FILTER (valid = 1 AND {test} AND target = 0))::BIGINT AS fp, (count(*) FILTER (valid = 1 AND NOT ({test}) AND target = 1))::BIGINT AS fn FROM px"""


_GRID = "g AS (SELECT unnest(range(17))::INT AS ordinal, unnest([" + ", ".join(f"{t}::DOUBLE" for t in C.THRESHOLDS) + "]) AS threshold)"
_SWEEP = f"""WITH {H.SQL}, {_GRID}, k AS (
  SELECT ordinal, threshold, vec_id, any_value(region) AS region, (count(*) FILTER (valid = 1 AND p >= threshold AND target = 1))::BIGINT AS tp,
    (count(*) FILTER (valid = 1 AND p >= threshold AND target = 0))::BIGINT AS fp, (count(*) FILTER (valid = 1 AND p < threshold AND target = 1))::BIGINT AS fn
  FROM px, g GROUP BY ordinal, threshold, vec_id
), s AS (SELECT *, {H.IOU} AS iou, {H.F1} AS f1 FROM k), b AS (
  SELECT vec_id, region, threshold AS best_threshold, iou AS best_iou, f1 AS best_f1 FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY iou DESC, ordinal) = 1
)"""


def _single(test: str) -> str:
    return f"WITH {H.SQL}, k AS ({counted(test)} GROUP BY vec_id), s AS (SELECT *, {H.IOU} AS iou, {H.F1} AS f1 FROM k)"


SQL = {
    "region_calibrated_summary": f"{_SWEEP} SELECT region, {H.SUMMARY.format(m='best_iou')} FROM b GROUP BY region",
    "region_calibrated_f1": f"{_SWEEP} SELECT region, {H.SUMMARY.format(m='best_f1')} FROM b GROUP BY region",
    "pixel_confusion_metrics": f"{_single('p >= 0.5')} SELECT vec_id, tp, fp, fn, iou, f1 FROM s",
    "strict_threshold_metrics": f"{_single('p > 0.5')} SELECT vec_id, tp, fp, fn, iou, f1 FROM s",
    "threshold_sweep_grid": f"{_SWEEP} SELECT vec_id, threshold, tp, fp, fn, iou, f1 FROM s",
    "best_threshold_first_wins": f"{_SWEEP} SELECT vec_id, best_threshold, best_iou, best_f1 FROM b",
    "argmax_region_metrics": f"""{_single("p > 1::DOUBLE - p")} SELECT region, count(*)::BIGINT AS n, round(avg(iou), 9) AS mean_iou, round(median(iou), 9) AS median_iou, min(iou) AS min_iou,
  round(avg(f1), 9) AS mean_f1, round(median(f1), 9) AS median_f1, min(f1) AS min_f1 FROM s GROUP BY region""",
    "dataset_mean_metrics": f"{_single('p >= 0.5')} SELECT round(coalesce(avg(iou), 0), 9) AS mean_iou, round(coalesce(avg(f1), 0), 9) AS mean_f1 FROM s",
    "region_report_lines": f"""{_single("p > 1::DOUBLE - p")}, a AS (SELECT region, count(*) AS n, avg(iou) AS m1, median(iou) AS m2, min(iou) AS m3, avg(f1) AS m4 FROM s GROUP BY region), told AS (SELECT *, CASE WHEN region = '' THEN '<untagged>' ELSE region END AS tag FROM a)
SELECT region, '  ' || lpad(tag, greatest(14, length(tag))::INT, ' ') || ': n=' || n || printf(' mean_iou=%.4f median_iou=%.4f min_iou=%.4f mean_f1=%.4f', m1, m2, m3, m4) AS line FROM told""",
    "sweep_report_lines": f"""{_SWEEP} SELECT vec_id AS aoi_index, 'AOI ' || vec_id || ' [' || CASE WHEN region = '' THEN '<untagged>' ELSE region END || ']: best thr=' || printf('%.2f', best_threshold) || ' area_filter=0m² IoU=' || printf('%.4f', best_iou) || ' F1=' || printf('%.4f', best_f1) AS line FROM b""",
    "labelled_prediction_metrics": f"""WITH k AS (
  SELECT source AS region, (count(*) FILTER (n_chars >= 1500 AND quality = 1))::BIGINT AS tp, (count(*) FILTER (n_chars >= 1500 AND quality <> 1))::BIGINT AS fp, (count(*) FILTER (n_chars < 1500 AND quality = 1))::BIGINT AS fn
  FROM labels JOIN documents USING (doc_id) WHERE toxic = 0 GROUP BY source
) SELECT *, {H.IOU} AS iou, {H.PREC} AS precision, {H.REC} AS recall, {H.F1} AS f1, {H.PANEL_F1} AS panel_f1 FROM k""",
    "region_metric_quantiles": f"SELECT l_returnflag AS region, {H.SUMMARY.format(m='l_discount')} FROM lineitem GROUP BY l_returnflag",
}
