"""Figures in messages against Python's own formatting."""

import math
import random

from pyspark.sql import functions as F

from tessera.functions.figures import figure, told


def test_figures_are_rounded_as_python_rounds(spark):
    rng = random.Random(4)
    values = [0.53125, 0.00015, 0.00025, 0.5, 1.5, 2.5, 0.0005, 0.0015, 0.99995, 1e-9, 0.0, 1.0, 12345.67895, 1e10 + 0.5, 1e12 + 0.25, -0.53125, -0.00001, -2.5, 0.1, 0.15, 0.25, 0.35]
    values += [rng.random() for _ in range(1500)] + [rng.randrange(20_000) / 32 for _ in range(1500)] + [rng.randrange(200_000) / 100_000 for _ in range(1500)] + [rng.random() * 10 ** rng.randrange(-6, 10) for _ in range(500)]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", *[figure(F.col("x"), n).alias(f"p{n}") for n in (0, 2, 3, 4)]).collect()
    for r in rows:
        assert [r[f"p{n}"] for n in (0, 2, 3, 4)] == [f"{r['x']:.{n}f}" for n in (0, 2, 3, 4)], r["x"]


def test_figures_of_odd_numbers(spark):
    rows = spark.createDataFrame([(None,), (math.nan,), (math.inf,), (-math.inf,)], "x double").select(figure(F.col("x"), 4).alias("f")).collect()
    assert [r["f"] for r in rows] == [None, "nan", "inf", "-inf"]


def test_templates_tell_all_or_nothing(spark):
    row = spark.range(1).select(told("%s of %s", F.lit(3), F.lit("x")).alias("a"), told("%s", F.lit(None).cast("string")).alias("b")).first()
    assert tuple(row) == ("3 of x", None)
