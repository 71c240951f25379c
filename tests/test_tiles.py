"""Tile bytes and shapes as columns."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import tiles
from tessera.operators import geometry, raster

points = st.tuples(st.integers(-5000, 9000), st.integers(-5000, 9000))
rings = st.lists(st.lists(points, min_size=3, max_size=9), min_size=1, max_size=4)
value = st.one_of(st.text(max_size=9), st.integers(-(1 << 40), 1 << 40), st.floats(allow_nan=False), st.booleans())


@given(st.text(max_size=9), st.lists(st.tuples(st.integers(0, 1 << 40), rings, st.dictionaries(st.text(max_size=5), value, max_size=3)), min_size=1, max_size=4), st.sampled_from([256, 4096]))
def test_tiles_come_back(name, features, extent):
    assert tiles.decode(tiles.encode(name, features, extent)) == {name: {"extent": extent, "features": features}}


def test_known_bytes():
    # fixed values: the stream of the triangle (3 6) (8 12) (20 34), as the format's description has it
    assert tiles.commands([[(3, 6), (8, 12), (20, 34)]]) == [9, 6, 12, 18, 10, 12, 24, 44, 15]
    assert tiles.encode("x", []) == b"" and tiles.decode(b"") == {}
    whole = tiles.encode("x", [(1, [[(0, 0), (1, 0), (1, 1)]], {"a": 1})])
    with pytest.raises((ValueError, IndexError)):
        tiles.decode(whole[:-3])
    with pytest.raises(ValueError, match="command 3"):
        tiles.rings_of([11, 1, 1])


def test_tiles_of_columns(spark):
    rows = spark.sql("SELECT array(named_struct('id', 4L, 'rings', array(array(array(0, 0), array(9, 0), array(9, 9)), array(array(2, 1), array(3, 2), array(3, 1))))) AS f UNION ALL SELECT array() UNION ALL SELECT null")
    got = rows.select(geometry.tile_bytes("road", F.col("f")).alias("t")).select("t", geometry.tile_features_of(F.col("t"), "road").alias("f"), geometry.tile_features_of(F.col("t"), "park").alias("none")).collect()
    assert [len(r["f"]) for r in got] == [1, 0, 0] and [bytes(r["t"]) for r in got][1:] == [b"", b""] and all(r["none"] == [] for r in got)
    assert got[0]["f"][0]["rings"] == [[[0, 0], [9, 0], [9, 9]], [[2, 1], [3, 2], [3, 1]]]


def test_polygons_of_columns(spark):
    label = np.full((4, 5), -1)
    label[:3, :3] = 0
    label[1, 1] = -1
    label[3, 4] = 19
    rows = spark.createDataFrame([(label.ravel().tolist(),), ([-1] * 20,), ([],), (None,)], "label array<int>").select(geometry.polygons(F.col("label"), 5).alias("p")).collect()
    assert [len(r["p"]) for r in rows] == [2, 0, 0, 0]
    assert rows[0]["p"][0]["shell"] == [[0, 0], [3, 0], [3, 3], [0, 3]] and rows[0]["p"][0]["holes"] == [[[1, 1], [1, 2], [2, 2], [2, 1]]]
    assert (rows[0]["p"][1]["component"], rows[0]["p"][1]["holes"]) == (19, [])


def test_shapes_of_odd_lines(spark):
    lines = [([[0.0, 0.0], [4.0, 0.0], [4.0, 3.0]], 0.5), ([[1.0, 1.0]], 1.0), ([], 1.0), (None, 1.0), ([[0.0, 0.0], [1.0, 0.0]], 0.0), ([[0.0, 0.0], [1.0, 0.0]], None), ([[2.0, 2.0], [2.0, 2.0]], 1.0)]
    rows = spark.createDataFrame(lines, "line array<array<double>>, half double").select(geometry.buffer_shape(F.col("line"), F.col("half")).alias("b")).collect()
    assert [len(r["b"]["rings"]) for r in rows] == [1, 0, 0, 0, 0, 0, 0] and all(r["b"]["area"] == 0 for r in rows[1:])
    assert rows[0]["b"]["area"] == pytest.approx(7 - 0.25 + 0.25 * np.pi / 4, abs=2e-3)


def test_spans_of_odd_rings(spark):
    square = [[1.0, 1.0], [4.0, 1.0], [4.0, 3.0], [1.0, 3.0]]
    rows = [(1, 1, [square]), (1, 2, [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]]), (2, 1, []), (2, 2, None), (2, 3, [[]]), (3, 1, [[[-9.0, -9.0], [99.0, -9.0], [99.0, 99.0], [-9.0, 99.0]], square]), (4, 1, [[[50.0, 50.0], [60.0, 50.0], [60.0, 60.0]]])]
    frame = spark.createDataFrame(rows, "area int, id int, rings array<array<array<double>>>")
    got = raster.merged_spans(raster.ring_spans(frame, "area", "id", "rings", 8, 8, 3)).groupBy("area").agg(F.sum(F.col("end") - F.col("begin")).alias("n")).collect()
    assert {r["area"]: r["n"] for r in got} == {1: 9, 3: 58}
    assert raster.ring_spans(frame.limit(0), "area", "id", "rings", 8, 8).count() == 0
