"""Components over seams against labelling the uncut raster."""

import numpy as np
import pytest

from tessera.operators import kernels, seams


def cut(masks, h, w):
    return [(k, r, c, m[r * h : r * h + h, c * w : c * w + w].astype(int).ravel().tolist()) for k, m in enumerate(masks) for r in range(m.shape[0] // h) for c in range(m.shape[1] // w)]


SCHEMA = "raster long, tile_row int, tile_col int, mask array<int>"


@pytest.mark.parametrize("seed", range(2))
def test_labels_of_tiles_are_those_of_the_raster(spark, seed):
    rng = np.random.default_rng(seed)
    h, w = ((4, 6), (5, 3))[seed]
    masks = [rng.random((h * 5, w * 4)) < share for share in (0.4, 0.6, 1.0, 0.0)]
    snake = np.zeros((h * 5, w * 4), bool)  # one component that winds through all tiles
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    masks.append(snake)
    got = seams.components(spark.createDataFrame(cut(masks, h, w), SCHEMA), h, w)
    found = [np.full(m.shape, -1, np.int64) for m in masks]
    for r in got.collect():
        found[r["raster"]][r["tile_row"] * h : r["tile_row"] * h + h, r["tile_col"] * w : r["tile_col"] * w + w] = np.array(r["label"]).reshape(h, w)
    sizes = {(r["raster"], r["component"]): r["size"] for r in seams.component_sizes(got).collect()}
    for k, (mask, own) in enumerate(zip(masks, found, strict=True)):
        label = kernels.label_masks(mask[None])[0]
        want = np.where(label >= 0, label // mask.shape[1] << 32 | label % mask.shape[1], -1)
        assert (own == want).all()
        assert {c: n for (r, c), n in sizes.items() if r == k} == dict(zip(*[x.tolist() for x in np.unique(want[want >= 0], return_counts=True)], strict=True))


def test_missing_and_empty_tiles_are_background(spark):
    rows = [(0, 0, 0, [1, 1, 1, 1]), (0, 0, 2, [1, 1, 1, 1]), (0, 1, 0, None), (0, 1, 1, [1, 0, 0, 0])]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {(r["tile_row"], r["tile_col"]): r["label"] for r in seams.components(frame, 2, 2).collect()}
    assert got == {(0, 0): [0] * 4, (0, 2): [4] * 4, (1, 0): [], (1, 1): [2 << 32 | 2, -1, -1, -1]}
    assert seams.components(frame.limit(0), 2, 2).count() == 0
