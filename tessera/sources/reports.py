"""Text reports, metadata and settings of jobs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.figures import figure, told

#: The fields of the metadata of an inference, in their order.
METADATA = (
    "aoi_index",
    "bbox",
    "region",
    "notes",
    "threshold",
    "area_filter_m2",
    "iou",
    "f1",
    "n_pred_polys",
    "n_gt_pixels",
    "n_pred_pixels",
    "n_valid_pixels",
    "n_total_pixels",
    "valid_fraction",
    "pixel_area_m2",
)


def metadata(rows: DataFrame) -> DataFrame:
    """One JSON object of all fields of ``METADATA`` for each row, which has w, s, e, n and the other fields as columns; nulls stay in it."""
    box = F.array("w", "s", "e", "n")
    fields = F.struct(*[(box if name == "bbox" else F.col(name)).alias(name) for name in METADATA])
    return rows.select("aoi_index", F.to_json(fields, {"ignoreNullFields": "false"}).alias("metadata"))


#: The lines of reports; a region's goes on with its figures.
REGION_LINE = "  %s: n=%s"
REGION_FIGURE = " {}=%s"
SWEEP_LINE = "AOI %s [%s]: best thr=%s area_filter=%sm² IoU=%s F1=%s"
EPOCH_LINE = "epoch %s: loss=%s val_iou=%s val_f1=%s"
BEST_EPOCH_LINE = "best epoch = %s (val_iou=%s)"
EVAL_LINES = ("IoU = %s", "F1  = %s")
AREA_LINE = "AOI %s [%s] bbox=(%s, %s, %s, %s)"
AREA_LINES = ("  notes: %s", "  IoU=%s  F1=%s", "  n_gt_pixels=%s  n_pred_pixels=%s", "  n_pred_polys=%s")
UNTAGGED = "<untagged>"


def _tag() -> Column:
    return F.when(F.coalesce("region", F.lit("")) == "", UNTAGGED).otherwise(F.col("region"))


def _or_none(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("None"))


def region_lines(summary: DataFrame, *figures: str) -> DataFrame:
    """(region, line) of a summary by region, in the order of regions: its tag, n and figures; without any tag no lines."""
    wide = F.lpad(_tag(), F.greatest(F.lit(14), F.length(_tag())), F.lit(" "))
    template = REGION_LINE + "".join(REGION_FIGURE.format(f) for f in figures)
    line = told(template, wide, F.col("n"), *[figure(F.col(f), 4) for f in figures])
    tagged = summary.agg(F.coalesce(F.bool_or(F.coalesce("region", F.lit("")) != ""), F.lit(False)))
    return summary.where(tagged.scalar()).select("region", line.alias("line")).orderBy("region")


def epoch_lines(epochs: DataFrame, *by: str) -> DataFrame:
    """(by..., epoch, line) of a training's epochs; a metric that was not taken is None."""
    line = told(EPOCH_LINE, F.lpad(F.col("epoch").cast("string"), F.greatest(F.lit(3), F.length(F.col("epoch").cast("string"))), F.lit(" ")), figure(F.col("train_loss_mean"), 4), _or_none(F.col("val_iou")), _or_none(F.col("val_f1")))
    return epochs.select(*by, "epoch", line.alias("line"))


def best_epoch_lines(best: DataFrame, *by: str) -> DataFrame:
    """(by..., line) of the best epochs."""
    return best.select(*by, told(BEST_EPOCH_LINE, F.col("best_epoch"), figure(F.col("best_val_iou"), 4)).alias("line"))


def eval_lines(metrics: DataFrame) -> DataFrame:
    """(ord, line) of mean metrics (mean_iou, mean_f1), a row each."""
    lines = F.array(told(EVAL_LINES[0], figure(F.col("mean_iou"), 4)), told(EVAL_LINES[1], figure(F.col("mean_f1"), 4)))
    return metrics.select(F.posexplode(lines).alias("ord", "line"))


def inference_lines(rows: DataFrame) -> DataFrame:
    """(aoi_index, ord, line) of areas' inferences, which have the fields of ``METADATA`` with w, s, e, n; an area without notes has no line for them."""
    c = F.col
    lines = F.array(
        told(AREA_LINE, c("aoi_index"), F.coalesce("region", F.lit("")), c("w"), c("s"), c("e"), c("n")),
        F.when(F.coalesce("notes", F.lit("")) != "", told(AREA_LINES[0], c("notes"))),
        told(AREA_LINES[1], figure(c("iou"), 4), figure(c("f1"), 4)),
        told(AREA_LINES[2], c("n_gt_pixels"), c("n_pred_pixels")),
        told(AREA_LINES[3], c("n_pred_polys")),
    )
    return rows.select("aoi_index", F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("ord", "line"))


def sweep_lines(rows: DataFrame) -> DataFrame:
    """(aoi_index, line) of each area's best threshold and area filter."""
    figures = [figure(F.col(c), places) for c, places in (("best_threshold", 2), ("best_area_filter_m2", 0), ("best_iou", 4), ("best_f1", 4))]
    return rows.select("aoi_index", told(SWEEP_LINE, F.col("aoi_index"), _tag(), *figures).alias("line"))


def history_report(epochs: DataFrame, run: str) -> DataFrame:
    """One JSON object for each run: its epochs in their order, the best one and those that were kept because they improved."""
    rows = F.struct("epoch", "train_loss_mean", "val_iou")
    found = epochs.groupBy(run).agg(F.array_sort(F.collect_list(rows)).alias("history"), F.max("best_epoch").alias("best_epoch"), F.array_sort(F.collect_list(F.when(F.col("improved"), F.col("epoch")))).alias("kept_epochs"))
    return found.select(run, F.to_json(F.struct("best_epoch", "kept_epochs", "history"), {"ignoreNullFields": "false"}).alias("report"))


def write_lines(rows: DataFrame, path: str, column: str = "line") -> None:
    """Report lines as text."""
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


@dataclass(frozen=True)
class Settings:
    """What a serving job takes from its environment."""

    models_dir: str = "/app/models"
    imagery_tile_base: str = ""
    threshold: float = 0.5
    max_geom_area_m2: float = 10_000.0

    @classmethod
    def of(cls, spark: SparkSession | None = None, environment: Mapping[str, str] | None = None) -> Settings:
        """From MODELS_DIR, IMAGERY_TILE_BASE, THRESHOLD and MAX_GEOM_AREA_M2; ``spark.tessera.<name>`` comes before them."""
        found = {}
        for name, default in cls().__dict__.items():
            value = spark.conf.get(f"spark.tessera.{name}", None) if spark is not None else None
            value = value if value is not None else (environment or {}).get(name.upper())
            found[name] = default if value is None else type(default)(value)
        return cls(**found)
