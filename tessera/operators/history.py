"""Training histories and keyed caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def epochs(steps: DataFrame, run: str, order: list[str], size: int) -> DataFrame:
    """Steps with their batch (in order, ``size`` rows each) and its ordinal from 0 within the run."""
    at = F.row_number().over(Window.partitionBy(run).orderBy(*order)) - 1
    return steps.withColumn("ordinal", at).withColumn("epoch", F.floor(F.col("ordinal") / size))


def best_epoch(history: DataFrame, run: str) -> DataFrame:
    """The first epoch of the largest validation metric above -1; without any metric the last epoch."""
    seen = F.col("val_iou") > -1
    best = F.max_by("epoch", F.when(seen, F.struct("val_iou", -F.col("epoch"))))
    return history.groupBy(run).agg(F.coalesce(best, F.max("epoch")).alias("best_epoch"), F.max(F.when(seen, F.col("val_iou"))).alias("best_val_iou"))


def running_best(history: DataFrame, run: str) -> DataFrame:
    """Whether an epoch improves strictly on all epochs before it."""
    before = Window.partitionBy(run).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    return history.withColumn("improved", F.coalesce(F.col("val_iou") > F.coalesce(F.max("val_iou").over(before), F.lit(-1.0)), F.lit(False)))


def masked_mean(loss: Column, valid: Column) -> Column:
    """The mean over valid pixels, over 1 at least."""
    return F.sum(loss * valid) / F.greatest(F.sum(valid), F.lit(1))


def cache_key(*parts: Column, **named: Column) -> Column:
    """32 hex digits of the parts in their order, then the named ones by name; for floats in plain notation."""
    told = [p.cast("string") for p in parts] + [F.concat(F.lit(f"{k}="), named[k].cast("string")) for k in sorted(named)]
    return F.substring(F.sha2(F.concat_ws("|", *told).cast("binary"), 256), 1, 32)


def misses(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """One row for each requested key that the cache lacks."""
    return requests.join(cache, key, "left_anti").dropDuplicates([key])


def fill(requests: DataFrame, cache: DataFrame, fetch, key: str = "key") -> DataFrame:
    """The cache with what was missing, fetched once for each key."""
    return cache.unionByName(fetch(misses(requests, cache, key)))
