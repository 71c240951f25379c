"""Kernels on vectors: buffers of lines, outlines of components. Small helpers inside Arrow UDFs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import geo, tiles
from tessera.operators import shapes
from tessera.operators.kernels import by_rows, dense


def buffer_degrees(width_m: Column, lat_ref: Column) -> Column:
    """Half a width in degrees, by the mean of a degree's metres in both directions at a latitude."""
    mean = (F.lit(geo.M_LAT) + geo.M_LON * F.greatest(F.lit(0.001), F.cos(F.radians(lat_ref)))) * 0.5
    return width_m / 2.0 / mean


def buffer_lines(line: Column, half: Column) -> Column:
    """A flat-capped rectangle [[x, y], ...] for each segment of a line of [x, y], which cover its buffer up to the joins; none for a half width of 0.

    Segments without length have none either. Plain arithmetic on arrays.
    """
    segments = F.filter(F.arrays_zip(F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))).alias("a"), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))).alias("b")), lambda s: (s["a"] != s["b"]) & (half > 0))

    def quad(s: Column) -> Column:
        x0, y0, x1, y1 = s["a"][0], s["a"][1], s["b"][0], s["b"][1]
        length = F.hypot(x1 - x0, y1 - y0)
        nx, ny = -(y1 - y0) / length * half, (x1 - x0) / length * half
        return F.array(F.array(x0 + nx, y0 + ny), F.array(x1 + nx, y1 + ny), F.array(x1 - nx, y1 - ny), F.array(x0 - nx, y0 - ny))

    return F.coalesce(F.transform(segments, quad), F.array().cast("array<array<array<double>>>"))


def buffer_shape(line: Column, half: Column, quarter: int = 16) -> Column:
    """A struct (area, rings) of the buffer of a line of [x, y] as one shape: flat ends, round joins of ``quarter`` steps a quarter circle.

    Shells turn left, holes right. Null lines and those without length or half width have area 0 and no rings.
    """

    @F.arrow_udf("struct<area:double,rings:array<array<array<double>>>>")
    def run(lines: pa.Array, halves: pa.Array) -> pa.Array:
        areas, rings = [np.zeros(0)], []
        pieces: list[np.ndarray] = []
        of: list[int] = []
        done = 0  # lines whose shapes are made
        corners = 0

        def unite(n: int) -> None:
            area, found, shape = shapes.unions(pieces, np.array(of, np.int64), n)
            areas.append(area)
            rings.extend([[] for _ in range(n)])
            for r, k in zip(found, shape.tolist(), strict=True):
                rings[done + k].append(r)

        sizes = lines.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = lines.flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 2)
        for nth, (line, h) in enumerate(zip(np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else [], halves.to_pylist(), strict=True)):
            own = shapes.strip(line, h or 0.0, quarter)
            pieces += own
            of += [nth - done] * len(own)
            corners += sum(map(len, own))
            if corners >= shapes.CORNERS:
                unite(nth + 1 - done)
                done, corners, pieces, of = nth + 1, 0, [], []
        unite(len(lines) - done)
        points = np.concatenate([np.zeros((0, 2)), *(r for own in rings for r in own)])
        ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        corner = pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1) * 2, pa.int32()), pa.array(points.ravel()))
        ring = pa.ListArray.from_arrays(ends([len(r) for own in rings for r in own]), corner)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(areas)), pa.ListArray.from_arrays(ends([len(own) for own in rings]), ring)], ["area", "rings"])

    return run(line, half)


def polygons(label: Column, width: int) -> Column:
    """A struct (component, shell, holes) for each component of a label array, by component; rings are the corners [column, row] where they turn.

    Shells run clockwise on the screen, holes the other way, both from their top left corner on. All
    borders of a chip are walked once.
    """

    def some(labels: pa.Array) -> pa.Array:
        out: list[list[dict]] = [[] for _ in range(len(labels))]
        for rows, own in dense(labels, np.int64):
            for row, label in zip(rows.tolist(), own, strict=True):
                corners, ends, component, area = shapes.borders(label.reshape(-1, width))
                found: dict[int, dict] = {k: {"component": k, "shell": None, "holes": []} for k in sorted(set(component.tolist()))}
                for ring, k, a in zip(np.split(corners, ends[:-1]), component.tolist(), area.tolist(), strict=True) if len(ends) else ():
                    if a > 0:
                        found[k]["shell"] = ring.tolist()
                    else:
                        found[k]["holes"].append(ring.tolist())
                out[row] = list(found.values())
        ring = pa.list_(pa.list_(pa.int32()))
        return pa.array(out, pa.list_(pa.struct([("component", pa.int32()), ("shell", ring), ("holes", pa.list_(ring))])))

    @F.arrow_udf("array<struct<component:int,shell:array<array<int>>,holes:array<array<array<int>>>>>")
    def run(labels: pa.Array) -> pa.Array:
        return by_rows(some, labels)

    return run(label)


def tile_bytes(layer: str, features: Column, extent: int = 4096) -> Column:
    """A tile's bytes from an array of structs (id, rings of points [x, y] in tile steps, y down); empty without features."""

    def some(column: pa.Array) -> pa.Array:
        return pa.array([tiles.encode(layer, [(f["id"], [[tuple(p) for p in r] for r in f["rings"]], {}) for f in own or []], extent) for own in column.to_pylist()], pa.binary())

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        return by_rows(some, column)

    return run(features)


def tile_features_of(tile: Column, layer: str) -> Column:
    """An array of structs (id, rings, commands) of a layer of a tile's bytes: what ``tile_bytes`` wrote, and the command stream of each feature."""

    def some(column: pa.Array) -> pa.Array:
        found = [tiles.decode(t).get(layer, {"features": []})["features"] if t else [] for t in column.to_pylist()]
        rows = [[{"id": i, "rings": [[list(p) for p in r] for r in rings], "commands": tiles.commands(rings)} for i, rings, _ in own] for own in found]
        ring = pa.list_(pa.list_(pa.int32()))
        return pa.array(rows, pa.list_(pa.struct([("id", pa.int64()), ("rings", pa.list_(ring)), ("commands", pa.list_(pa.int64()))])))

    @F.arrow_udf("array<struct<id:long,rings:array<array<array<int>>>,commands:array<long>>>")
    def run(column: pa.Array) -> pa.Array:
        return by_rows(some, column)

    return run(tile)


def simple_ring(points: Column) -> Column:
    """Whether a ring of [x, y] (its first corner not repeated) has an area and no two of its sides meet but at their common corner; false for null."""

    @F.arrow_udf("boolean")
    def run(rings: pa.Array) -> pa.Array:
        sizes = rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = rings.flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 2)
        return pa.array(shapes.simple_rings(flat[:, 0], flat[:, 1], sizes))

    return run(points)


def valid_way(kind: Column, line: Column) -> Column:
    """Whether a way of [x, y] has a shape: a simple ring for a polygon, two different corners for a line."""
    ring = F.when(kind == "Polygon", F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))))
    return F.when(kind == "Polygon", simple_ring(ring)).otherwise(F.size(F.array_distinct(line)) >= 2)
