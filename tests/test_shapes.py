"""Kernels on shapes against plain loops and fine grids."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import geometry, kernels, shapes


def signed(ring):
    x, y = ring[:, 0], ring[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def inside(rings, px, py):
    """Even-odd rule by a loop over sides."""
    odd = np.zeros(len(px), bool)
    for ring in rings:
        for (x, y), (x2, y2) in zip(ring, np.roll(ring, -1, 0), strict=True):
            if (y > py).any() or (y2 > py).any():
                crosses = (y > py) != (y2 > py)
                with np.errstate(divide="ignore", invalid="ignore"):
                    odd ^= crosses & (px < (x2 - x) * (py - y) / (y2 - y) + x)
    return odd


def split(corners, ends):
    return np.split(corners, ends[:-1]) if len(ends) else []


@pytest.mark.parametrize("seed", range(12))
def test_borders_hold_their_components(seed):
    rng = np.random.default_rng(seed)
    h, w = rng.integers(1, 14, 2)
    mask = rng.random((h, w)) < rng.choice([0.3, 0.6, 0.8])
    label = kernels.label_masks(mask[None])[0]
    corners, ends, component, area = shapes.borders(label)
    rings = split(corners, ends)
    py, px = (np.stack(np.meshgrid(np.arange(h), np.arange(w), indexing="ij")).reshape(2, -1) + 0.5).tolist()
    for k in np.unique(label[label >= 0]).tolist():
        own = [r for r, c in zip(rings, component, strict=True) if c == k]
        areas = area[component == k]
        assert (areas > 0).sum() == 1 and areas.sum() == (label == k).sum() and [signed(r) for r in own] == areas.tolist()
        assert inside(own, np.array(px), np.array(py)).reshape(h, w).tolist() == (label == k).tolist()
    assert len(rings) == 0 or set(component) == set(label[label >= 0])
    for r in rings:
        (cx, cy), (gx, gy) = (r - np.roll(r, 1, 0)).T, (np.roll(r, -1, 0) - r).T
        assert (cx * gy != cy * gx).all() and tuple(r[0][::-1]) == min(map(tuple, r[:, ::-1]))


def test_holes_touch_and_nest():
    label = np.full((7, 7), 0)
    label[1:6, 1:6] = -1
    label[2:5, 2:5] = 16
    label[3, 3] = -1
    corners, ends, component, area = shapes.borders(label)
    assert sorted(zip(component.tolist(), area.tolist(), strict=True)) == [(0, -25), (0, 49), (16, -1), (16, 9)]
    two = np.zeros((4, 4), np.int64)
    two[1, 1] = two[2, 2] = -1  # touch by a corner: one hole, since the cells round them are joined by their sides only
    assert sorted(shapes.borders(two)[3].tolist()) == [-2, 16]


def test_borders_of_a_large_chip_are_quick():
    label = kernels.label_masks((np.random.default_rng(0).random((1, 1024, 1024)) < 0.6))[0]
    smooth = np.add.outer(np.sin(np.arange(1024) / 9), np.cos(np.arange(1024) / 7)) > 0.2
    blobs = kernels.label_masks(smooth[None])[0]
    began = time.perf_counter()
    area = shapes.borders(blobs)[3]
    took = time.perf_counter() - began
    assert area.sum() == smooth.sum() and took < 1
    assert shapes.borders(label)[3].sum() == (label >= 0).sum()


def simple_by_hand(ring):
    n = len(ring)
    if n < 3 or signed(ring) == 0:
        return False
    side = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    for i in range(n):
        for j in range(i + 2, n):
            if (i, j) == (0, n - 1):
                continue
            a, b, c, d = ring[i], ring[(i + 1) % n], ring[j], ring[(j + 1) % n]
            boxes = all(max(a[k], b[k]) >= min(c[k], d[k]) and max(c[k], d[k]) >= min(a[k], b[k]) for k in (0, 1))
            if boxes and side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0:
                return False
    return True


def test_simple_rings_against_all_pairs():
    rng = np.random.default_rng(3)
    rings = [rng.integers(0, 6, (int(n), 2)).astype(float) for n in rng.integers(0, 8, 300)]
    angle = [np.sort(rng.random(9)) * 2 * np.pi for _ in range(60)]
    rings += [np.column_stack([np.cos(a), np.sin(a)]) * rng.uniform(1, 3, (9, 1)) for a in angle]
    flat = np.concatenate(rings)
    got = shapes.simple_rings(flat[:, 0], flat[:, 1], np.array([len(r) for r in rings]))
    assert got.tolist() == [simple_by_hand(r) for r in rings] and got.any() and not got.all()
    assert shapes.simple_rings(np.zeros(0), np.zeros(0), np.zeros(0, np.int64)).tolist() == []


def test_rings_of_many_corners_are_quick():
    a = np.linspace(0, 2 * np.pi, 2000, endpoint=False)
    star = np.column_stack([np.cos(a), np.sin(a)]) * (2 + np.sin(40 * a))[:, None]
    began = time.perf_counter()
    assert shapes.simple_rings(star[:, 0], star[:, 1], np.array([2000])).all()
    assert time.perf_counter() - began < 1
    star[1000] = star[3]
    assert not shapes.simple_rings(star[:, 0], star[:, 1], np.array([2000])).any()


def covered(pieces, px, py):
    out = np.zeros(len(px), bool)
    for p in pieces:
        out |= inside([p], px, py)
    return out


@pytest.mark.parametrize("seed", range(10))
def test_unions_cover_what_their_pieces_cover(seed):
    rng = np.random.default_rng(seed)
    line = rng.uniform(0, 4, (int(rng.integers(2, 9)), 2))
    if seed % 3 == 0:
        line = np.round(line)
    pieces = shapes.strip(line, 0.2 + 0.3 * rng.random())
    assert all(signed(p) > 0 for p in pieces)
    area, rings = shapes.union(pieces)
    assert area == pytest.approx(sum(map(signed, rings)), rel=1e-9)
    px, py = rng.uniform(-1, 5, (2, 6000))
    assert (inside(rings, px, py) == covered(pieces, px, py)).all()


def test_a_loop_has_a_hole_and_a_straight_line_none():
    loop = np.array([[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.5]])
    area, rings = shapes.union(shapes.strip(loop, 0.75))
    assert sorted(np.sign([signed(r) for r in rings])) == [-1, 1] and signed(min(rings, key=signed)) == pytest.approx(-2.5**2)
    area, rings = shapes.union(shapes.strip(np.array([[0.0, 0.0], [1.0, 0.5], [1.0, 0.5], [4.0, 2.0]]), 0.5))
    assert area == pytest.approx(2 * 0.5 * np.hypot(4, 2)) and len(rings) == 1 and len(rings[0]) == 4
    assert shapes.union(shapes.strip(np.zeros((3, 2)), 1.0)) == (0.0, []) and shapes.strip(loop, 0.0) == []


def test_many_unions_at_once_equal_each_by_itself():
    rng = np.random.default_rng(5)
    lines = [rng.integers(0, 5, (int(n), 2)).astype(float) for n in rng.integers(0, 7, 300)]
    strips = [shapes.strip(line, 0.2) for line in lines]
    area, rings, of = shapes.unions([p for s in strips for p in s], np.repeat(np.arange(300), [len(s) for s in strips]), 300)
    assert (np.diff(of) >= 0).all()
    for k, s in enumerate(strips):
        alone, own = shapes.union(s)
        found = [r for r, shape in zip(rings, of, strict=True) if shape == k]
        assert area[k] == pytest.approx(alone, rel=1e-12) and len(found) == len(own) and all(np.array_equal(a, b) for a, b in zip(found, own, strict=True))


def test_many_unions_at_once_are_quick():
    strips = [shapes.strip(np.array([[float(i % 3 + k % 7), float(i)] for i in range(3)]), 0.1) for k in range(400)]
    began = time.perf_counter()
    each = [shapes.union(s)[0] for s in strips]
    between = time.perf_counter()
    area, rings, _ = shapes.unions([p for s in strips for p in s], np.repeat(np.arange(400), [len(s) for s in strips]), 400)
    assert time.perf_counter() - between < (between - began) / 2 and len(rings) == 400 and area.tolist() == pytest.approx(each)


def test_buffers_of_many_batches(spark):
    lines = [[[float(i % 3 + k % 7), float(i)] for i in range(5)] for k in range(600)] + [None, []]  # more corners than are united at once
    frame = spark.createDataFrame([(k, line) for k, line in enumerate(lines)], "k int, line array<array<double>>").coalesce(1)
    got = [r["b"] for r in frame.select("k", geometry.buffer_shape(F.col("line"), F.lit(0.1)).alias("b")).orderBy("k").collect()]
    assert [len(b["rings"]) for b in got] == [1] * 600 + [0, 0] and got[-1]["area"] == got[-2]["area"] == 0
    for k in (0, 1, 272, 273, 599):
        area, rings = shapes.union(shapes.strip(np.array(lines[k]), 0.1))
        assert got[k]["area"] == pytest.approx(area, rel=1e-12) and got[k]["rings"] == [r.tolist() for r in rings]


def test_long_lines_are_quick():
    t = np.linspace(0, 60, 600)
    line = np.column_stack([t * np.cos(t), t * np.sin(t)])
    began = time.perf_counter()
    area, rings = shapes.union(shapes.strip(line, 0.4, 4))
    assert time.perf_counter() - began < 10 and area == pytest.approx(sum(map(signed, rings)), rel=1e-9)


@pytest.mark.parametrize("seed", range(6))
def test_spans_are_the_centres_inside(seed):
    rng = np.random.default_rng(seed)
    outer = rng.uniform(-3, 23, (int(rng.integers(3, 12)), 2))
    hole = rng.uniform(5, 15, (4, 2)) if seed % 2 else np.zeros((0, 2))
    rings = [r if seed < 4 else np.round(r) for r in (outer, hole) if len(r)]
    sides = np.concatenate([np.column_stack([r, np.roll(r, -1, 0)]) for r in rings])
    burned = np.zeros((20, 20), bool)
    for first in (0, 7, 14):
        rows = [np.full(len(sides), r) for r in (first, min(first + 7, 20))]
        for _, r, a, b in zip(*shapes.spans(*sides.T, *rows, 20, np.zeros(len(sides), np.int64)), strict=True):
            burned[r, a:b] ^= True
    py, px = np.stack(np.meshgrid(np.arange(20), np.arange(20), indexing="ij")).reshape(2, -1) + 0.5
    assert (burned.ravel() == inside(rings, px, py)).all()
