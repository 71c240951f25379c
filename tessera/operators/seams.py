"""Components of rasters that are cut into chips: labels of chips joined over their seams.

A chip is labelled by itself. Only the names along its borders meet those of the chips to the right
and below; a pair of set pixels on both sides of a seam joins two names. The graph of names shrinks
round by round: each name points to its least neighbour if that is less, pointers are jumped until they
end at roots, and the edges between roots are what is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import kernels as K
from tessera.operators import raster as R
from tessera.sources.scratch import discard, stored

#: A name is a pixel's row and column in its raster, the row in the upper 32 bits.
ROW = 32
TILE = ("raster", "tile_row", "tile_col")


def named(label: Column, tile_row: Column, tile_col: Column, height: int, width: int) -> Column:
    """Labels of a chip as names in the raster (array<long>), -1 outside components."""

    @F.arrow_udf("array<long>")
    def run(labels: pa.Array, rows: pa.Array, cols: pa.Array) -> pa.Array:
        first = [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (rows, cols)]

        def names(at: np.ndarray, own: np.ndarray) -> np.ndarray:
            row, col = own // width + first[0][at][:, None] * height, own % width + first[1][at][:, None] * width
            return np.where(own >= 0, row << ROW | col, -1)

        return K.each(labels, np.int64, pa.int64(), names)

    return run(label, tile_row, tile_col)


def seams(chips: DataFrame, height: int, width: int) -> DataFrame:
    """(raster, a, b) of names that meet at a seam, each pair once; chips are (raster, tile_row, tile_col, label of names)."""
    side = lambda first, step, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get("label", (first + i * step).cast("int")))
    parts = []
    for dr, dc, own, other, n in ((0, 1, (width - 1, width), (0, width), height), (1, 0, ((height - 1) * width, 1), (0, 1), width)):
        ours = chips.select("raster", (F.col("tile_row") + dr).alias("tile_row"), (F.col("tile_col") + dc).alias("tile_col"), side(*own, n).alias("ours"))
        theirs = chips.select(*TILE, side(*other, n).alias("theirs"))
        met = F.array_distinct(F.filter(F.arrays_zip("ours", "theirs"), lambda x: (x["ours"] >= 0) & (x["theirs"] >= 0)))
        parts.append(ours.join(theirs, list(TILE)).select("raster", F.explode(met).alias("p")).select("raster", F.col("p.ours").alias("a"), F.col("p.theirs").alias("b")))
    return parts[0].union(parts[1]).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(raster, name, root) of all names of edges (raster, a, b): the least name that they reach."""
    edges = stored(edges.where("a <> b"), "edges")
    found = stored(edges.select("raster", F.explode(F.array("a", "b")).alias("name")).distinct().withColumn("root", F.col("name")), "roots")
    while not edges.isEmpty():
        both = edges.union(edges.select("raster", F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy("raster", F.col("a").alias("name")).agg(F.least(F.min("b"), F.col("name")).alias("up")), "up")
        while True:  # jump until all pointers end at a name that points to itself
            next_up = up.select("raster", F.col("name").alias("up"), F.col("up").alias("further"))
            jumped = stored(up.join(next_up, ["raster", "up"]).select("raster", "name", F.col("further").alias("up")), "up")
            same = jumped.agg(F.sum("up").alias("s")).first()["s"] == up.agg(F.sum("up").alias("s")).first()["s"]
            discard(up)
            up = jumped
            if same:  # pointers only ever fall, so equal sums are equal pointers
                break
        to = lambda c: up.select("raster", F.col("name").alias(c), F.col("up").alias(f"{c}_up"))  # noqa: E731, B023
        left = stored(edges.join(to("a"), ["raster", "a"]).join(to("b"), ["raster", "b"]).where("a_up <> b_up").select("raster", F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "edges")
        moved = stored(found.join(to("root"), ["raster", "root"], "left").select("raster", "name", F.coalesce("root_up", "root").alias("root")), "roots")
        for old in (edges, found, up):
            discard(old)
        edges, found = left, moved
    discard(edges)
    return found


def components(tiles: DataFrame, height: int, width: int) -> DataFrame:
    """``tiles`` (raster, tile_row, tile_col, mask) with ``label``: each pixel's component in its whole raster (array<long>), -1 outside.

    A component is named by its first pixel by rows, as row << 32 | column. Tiles are all ``height`` by
    ``width`` and each place has one; a missing tile is background, a null mask as well. Rasters of any
    size: only names along seams are joined, never pixels.
    """
    own = tiles.select(*TILE, named(R.labels(F.col("mask"), width), F.col("tile_row"), F.col("tile_col"), height, width).alias("label"))
    chips = stored(own, "chips")
    whole = chips.where(F.size("label") == height * width)
    root = roots(seams(whole, height, width))
    border = F.array_distinct(F.filter("label", lambda x: x >= 0))
    renamed = chips.select(*TILE, F.explode(border).alias("name")).join(root.where("name <> root"), ["raster", "name"]).groupBy(*TILE).agg(F.collect_list(F.struct("name", "root")).alias("renamed"))

    @F.arrow_udf("array<long>")
    def run(labels: pa.Array, pairs: pa.Array) -> pa.Array:
        out = []
        for label, own in zip(labels, pairs.to_pylist(), strict=True):
            values = np.array(label.as_py() or [], np.int64)
            if own:
                name, to = np.array(sorted((p["name"], p["root"]) for p in own), np.int64).T
                at = np.minimum(np.searchsorted(name, values), len(name) - 1)
                values = np.where(name[at] == values, to[at], values)
            out.append(values)
        return pa.array(out, pa.list_(pa.int64()))

    return tiles.join(chips.join(renamed, list(TILE), "left").select(*TILE, run(F.col("label"), F.col("renamed")).alias("label")), list(TILE))


def component_sizes(labelled: DataFrame) -> DataFrame:
    """(raster, component, size) of labelled tiles, counted within tiles first."""
    names = labelled.select("raster", F.explode(F.filter("label", lambda x: x >= 0)).alias("component"))
    return names.groupBy("raster", "component").agg(F.count(F.lit(1)).alias("size"))
