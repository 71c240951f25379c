"""The model seam: a pixel classifier in place of a segmentation network, which has no Spark equivalent.

Features are a pixel and the mean of its neighbours; IoU values of this model say nothing about a
network's.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def features(chips: DataFrame, side: int) -> DataFrame:
    """(vec_id, i, own, around, target, valid) of every pixel of chips."""
    px = chips.select("vec_id", "px", F.explode("px").alias("x"))
    row, col = F.floor(F.col("x.i") / side), F.col("x.i") % side
    near = []
    for dr in (-1, 0, 1):
        for dc in (-1, 0, 1):
            if dr or dc:
                inside = (row + dr >= 0) & (row + dr < side) & (col + dc >= 0) & (col + dc < side)
                near.append(F.when(inside, F.get("px", (F.col("x.i") + dr * side + dc).cast("int"))["p"]))
    known = F.filter(F.array(*near), lambda v: v.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.greatest(F.size(known), F.lit(1))
    return px.select("vec_id", F.col("x.i").alias("i"), F.col("x.p").alias("own"), mean.alias("around"), F.col("x.target").cast("double").alias("target"), F.col("x.valid").cast("double").alias("valid"))


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=["own", "around"], outputCol="features").transform(rows)


def fit(rows: DataFrame, iterations: int = 10, regularization: float = 1e-3) -> LogisticRegressionModel:
    """Fits with validity as weight, so invalid pixels count nothing. The start is zero for all weights, so there is nothing to seed."""
    return LogisticRegression(labelCol="target", weightCol="valid", maxIter=iterations, regParam=regularization).fit(_vectors(rows))


def predict(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``p``, the probability of class one."""
    return model.transform(_vectors(rows)).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def save(model: LogisticRegressionModel, path: str, best_threshold: float | None = None, **meta) -> None:
    """Writes a model and what is known of it: metadata, and the threshold that suits it best."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(best_threshold, json.dumps(meta))], "best_threshold double, meta string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load(path: str, default_threshold: float = 0.5) -> tuple[LogisticRegressionModel, float, dict]:
    """(model, its best threshold or the default, metadata) of a saved model."""
    model = LogisticRegressionModel.load(f"{path}/model")
    found = SparkSession.active().read.schema("best_threshold double, meta string").json(f"{path}/meta").first()
    threshold = default_threshold if found["best_threshold"] is None else found["best_threshold"]
    return model, threshold, json.loads(found["meta"])


def load_or_fit(path: str, rows: DataFrame, default_threshold: float = 0.5) -> tuple[LogisticRegressionModel, float, bool]:
    """(model, threshold, whether it was found); where there is none, one is fitted on ``rows`` with the default threshold."""
    try:
        model, threshold, _ = load(path, default_threshold)
    except (AnalysisException, Py4JJavaError) as e:
        if "not exist" not in str(e):
            raise
        return fit(rows), default_threshold, False
    return model, threshold, True
