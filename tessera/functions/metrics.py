"""Confusion metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(tp: Column, fp: Column, fn: Column) -> Column:
    """Intersection over union; 1 for an empty union."""
    return F.when(tp + fp + fn == 0, F.lit(1.0)).otherwise(tp / F.greatest(tp + fp + fn, F.lit(1)))


def precision(tp: Column, fp: Column) -> Column:
    return F.when(tp + fp == 0, F.lit(0.0)).otherwise(tp / F.greatest(tp + fp, F.lit(1)))


def panel_f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 as a report panel shows it: 0 where nothing is positive."""
    p, r = precision(tp, fp), precision(tp, fn)
    return F.when(p + r == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / F.when(p + r == 0, F.lit(1.0)).otherwise(p + r))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 from precision and recall; 1 where nothing is positive, 0 without true positives."""
    return F.when(tp + fp + fn == 0, F.lit(1.0)).when(tp == 0, F.lit(0.0)).otherwise(panel_f1(tp, fp, fn))


def at_least(p: Column, threshold: Column | float) -> Column:
    """The comparison of sweeps and reports."""
    return p >= threshold


def above(p: Column, threshold: Column | float) -> Column:
    """The comparison of tiles."""
    return p > threshold


def class_one(p0: Column, p1: Column) -> Column:
    """The arg-max of two classes: one only if strictly larger."""
    return p1 > p0


def softmax_one(l0: Column, l1: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(l0 - l1))


def first_best(metric: Column, ordinal: Column, *carried: Column) -> Column:
    """The struct ``carried`` of the row with the largest metric; of equal ones, of the first by ordinal."""
    return F.max_by(F.struct(*carried), F.struct(metric, -ordinal))
