"""Windows of blocked rasters against whole ones, and how little they read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import raster
from tessera.sources import pyramid

SIDE, LEVELS = 4, 3


def overview(a):
    h, w = (-(-n // 2) for n in a.shape)
    out = np.full((h, w), np.nan)
    for r in range(h):
        for c in range(w):
            own = a[2 * r : 2 * r + 2, 2 * c : 2 * c + 2]
            out[r, c] = np.nan if np.isnan(own).all() else np.nanmean(own)
    return out


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    whole = {k: rng.random(s) for k, s in ((1, (50, 37)), (2, (64, 64)), (3, (3, 5)))}
    whole[1][10:20, 5:9] = np.nan
    rows = []
    for k, a in whole.items():
        h, w = (-(-n // SIDE) * SIDE for n in a.shape)
        padded = np.pad(a, ((0, h - a.shape[0]), (0, w - a.shape[1])), constant_values=np.nan)
        rows += [(k, r, c, padded[r * SIDE : r * SIDE + SIDE, c * SIDE : c * SIDE + SIDE].ravel().tolist()) for r in range(h // SIDE) for c in range(w // SIDE)]
    path = str(tmp_path_factory.mktemp("pyramid"))
    pyramid.write_pyramid(spark.createDataFrame(rows, pyramid.BLOCK), path, SIDE, LEVELS)
    return path, whole


@pytest.mark.parametrize("window,max_side,level", [((8, 4, 23, 18), 64, 0), ((1, 2, 30, 33), 16, 1), ((0, 0, 50, 37), 13, 2), ((0, 0, 64, 64), 2, 3)])
def test_windows_equal_the_whole(spark, stored, window, max_side, level):
    path, whole = stored
    for k, a in whole.items():
        for _ in range(level):
            a = overview(a)
        up = 1 << level
        r0, c0, r1, c1 = window[0] // up, window[1] // up, -(-window[2] // up), -(-window[3] // up)
        got = pyramid.read_window(spark, path, window, max_side, SIDE, LEVELS, k).collect()
        if a.shape[0] <= r0 // SIDE * SIDE or a.shape[1] <= c0 // SIDE * SIDE:
            assert not got
            continue
        want = np.full((r1 - r0, c1 - c0), np.nan)
        own = a[r0:r1, c0:c1]
        want[: own.shape[0], : own.shape[1]] = own
        assert (got[0]["level"], got[0]["row"], got[0]["col"]) == (level, r0, c0)
        assert np.allclose(np.array(got[0]["values"]).reshape(want.shape), want, equal_nan=True)
    assert pyramid.read_window(spark, path, window, max_side, SIDE, LEVELS).count() == len([1 for a in whole.values() if a.shape[0] > window[0] // (SIDE << level) * (SIDE << level) and a.shape[1] > window[1] // (SIDE << level) * (SIDE << level)])


def test_blocks_that_are_read_grow_with_the_window(spark, stored):
    path, _ = stored
    read = [pyramid.window_blocks(spark, path, (16, 16, 16 + n, 16 + n), 0, SIDE, 2).count() for n in (4, 8, 16, 48)]
    assert read == [1, 4, 16, 144]
    files = spark.read.parquet(f"{path}/level=0").select(F.input_file_name().alias("f"))
    near = pyramid.window_blocks(spark, path, (0, 0, 4, 4), 0, SIDE, 2)
    assert near.select(F.input_file_name()).distinct().count() == 1 < files.distinct().count()
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = near._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(morton" in plan and "EqualTo(raster,2)" in plan


def test_resampling_a_window_is_resampling_the_whole(spark, stored):
    path, whole = stored
    rows, cols = np.meshgrid(np.linspace(20.3, 30.1, 5), np.linspace(9.5, 26.2, 7), indexing="ij")
    window = (20, 9, 32, 28)
    got = pyramid.read_window(spark, path, window, 64, SIDE, LEVELS, 2).select(raster.resample(F.col("values"), 19, rows - 20, cols - 9).alias("v")).first()["v"]
    all_ = spark.createDataFrame([(whole[2].ravel().tolist(),)], "v array<double>").select(raster.resample(F.col("v"), 64, rows, cols).alias("v")).first()["v"]
    assert np.allclose(got, all_, atol=1e-12)


def test_windows_without_a_size_are_refused(spark, stored):
    with pytest.raises(ValueError, match="empty window"):
        pyramid.window_blocks(spark, stored[0], (4, 4, 4, 9), 0, SIDE)
    assert pyramid.level_for(100, 10, 1, 3) == 3 and pyramid.level_for(100, 10, 100, 3) == 0
