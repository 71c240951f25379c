"""Rasters in blocks with overviews, of which a window reads only what it needs.

A raster is a table of square blocks, each a row. Blocks of a level are sorted by raster and Morton
key, which keeps neighbours together, so files and row groups hold small areas and their statistics let
the scan pass over the rest. The next level halves both sides: four blocks become one. A window names
the longest side that it wants at most and reads the finest level that fits.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a block's row and column in its Morton key.
BITS = 24
BLOCK = "raster long, block_row int, block_col int, values array<double>"


def morton(row: Column, col: Column) -> Column:
    """The bits of row and column by turns, the row's first; blocks that are near have keys that are near, and a square's keys lie between those of its corners."""
    bit = lambda c, k: F.shiftleft(F.shiftright(c.cast("long"), k).bitwiseAND(F.lit(1).cast("long")), 2 * k)
    return reduce(lambda a, b: a + b, [F.shiftleft(bit(row, k), 1) + bit(col, k) for k in range(BITS)])


def _quarter(side: int):  # noqa: ANN202
    """A UDF from the up to four blocks (at, values) of a square to their overview; NaN counts nothing, and all of NaN stay NaN."""

    @F.arrow_udf("array<double>")
    def run(parts: pa.Array) -> pa.Array:
        out = []
        for own in parts.to_pylist():
            whole = np.full((2 * side, 2 * side), np.nan)
            for p in own:
                r, c = divmod(p["at"], 2)
                whole[r * side : r * side + side, c * side : c * side + side] = np.array(p["values"]).reshape(side, side)
            cells = whole.reshape(side, 2, side, 2).transpose(0, 2, 1, 3).reshape(side, side, 4)
            known = ~np.isnan(cells)
            sums = np.where(known, cells, 0)
            total = (sums[..., 0] + sums[..., 1]) + (sums[..., 2] + sums[..., 3])
            n = known.sum(-1)
            out.append(np.where(n > 0, total / np.maximum(n, 1), np.nan).ravel())
        return pa.array(out, pa.list_(pa.float64()))

    return run(F.col("parts"))


def write_pyramid(blocks: DataFrame, path: str, side: int, levels: int, files: int = 8) -> None:
    """Writes blocks (raster, block_row, block_col, values of ``side`` by ``side``, NaN beyond the raster) and ``levels`` overviews of them.

    Blocks that are missing are unknown. Every place has one block. Each level is made from the one before, which is read back from its files.
    """
    spark = blocks.sparkSession
    level = blocks.select("raster", F.col("block_row").cast("int").alias("block_row"), F.col("block_col").cast("int").alias("block_col"), "values")
    for k in range(levels + 1):
        keyed = level.withColumn("morton", morton(F.col("block_row"), F.col("block_col")))
        keyed.repartitionByRange(max(1, files >> 2 * k), "raster", "morton").sortWithinPartitions("raster", "morton").write.mode("overwrite").parquet(f"{path}/level={k}")
        written = spark.read.parquet(f"{path}/level={k}")
        up = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
        part = F.struct((F.col("block_row") % 2 * 2 + F.col("block_col") % 2).alias("at"), "values")
        level = written.groupBy("raster", up("block_row"), up("block_col")).agg(F.collect_list(part).alias("parts")).select("raster", "block_row", "block_col", _quarter(side).alias("values"))


def level_for(height: int, width: int, max_side: int, levels: int) -> int:
    """The finest level at which a window of this size has no side above ``max_side``; the coarsest where none has."""
    longest = max(height, width)
    return next((k for k in range(levels + 1) if math.ceil(longest / (1 << k)) <= max_side), levels)


def window_blocks(spark: SparkSession, path: str, window: tuple[int, int, int, int], level: int, side: int, raster: int | None = None) -> DataFrame:
    """The blocks of a level that a window (first row, first column, last row, last column, ends excluded, in pixels of level 0) meets.

    All conditions go down to the scan; of a level's files only those whose keys can meet the window are read.
    """
    r0, c0, r1, c1 = _at_level(window, level)
    rows, cols = (r0 // side, (r1 - 1) // side), (c0 // side, (c1 - 1) // side)
    key = lambda row, col: sum((row >> k & 1) << 2 * k + 1 | (col >> k & 1) << 2 * k for k in range(BITS))
    found = spark.read.schema(f"{BLOCK}, morton long").parquet(f"{path}/level={level}")
    inside = F.col("block_row").between(*rows) & F.col("block_col").between(*cols) & F.col("morton").between(key(rows[0], cols[0]), key(rows[1], cols[1]))
    return found.where(inside if raster is None else inside & (F.col("raster") == raster))


def _at_level(window: tuple[int, int, int, int], level: int) -> tuple[int, int, int, int]:
    r0, c0, r1, c1 = window
    if not (0 <= r0 < r1 and 0 <= c0 < c1):
        raise ValueError(f"an empty window {window}")
    up = 1 << level
    return r0 // up, c0 // up, -(-r1 // up), -(-c1 // up)


def read_window(spark: SparkSession, path: str, window: tuple[int, int, int, int], max_side: int, side: int, levels: int, raster: int | None = None) -> DataFrame:
    """(raster, level, row, col, height, width, values): a window of one raster, or of every one that has a block there, at the level that fits.

    row and col are the first pixel's in the level. What no block covers is NaN. A group has the blocks of
    one window, of which ``max_side`` bounds the number.
    """
    level = level_for(window[2] - window[0], window[3] - window[1], max_side, levels)
    r0, c0, r1, c1 = _at_level(window, level)

    def stitch(group: pa.Table) -> pa.Table:
        out = np.full((r1 - r0, c1 - c0), np.nan)
        for row in group.to_pylist():
            top, left = row["block_row"] * side - r0, row["block_col"] * side - c0
            own = np.array(row["values"]).reshape(side, side)
            a, b, c, d = max(top, 0), min(top + side, r1 - r0), max(left, 0), min(left + side, c1 - c0)
            out[a:b, c:d] = own[a - top : b - top, c - left : d - left]
        one = {"raster": group.column("raster")[0].as_py(), "level": level, "row": r0, "col": c0, "height": r1 - r0, "width": c1 - c0, "values": out.ravel().tolist()}
        return pa.Table.from_pylist([one], pa.schema([("raster", pa.int64()), *[(n, pa.int32()) for n in ("level", "row", "col", "height", "width")], ("values", pa.list_(pa.float64()))]))

    blocks = window_blocks(spark, path, window, level, side, raster).select("raster", "block_row", "block_col", "values")
    return blocks.groupBy("raster").applyInArrow(stitch, "raster long, level int, row int, col int, height int, width int, values array<double>")
