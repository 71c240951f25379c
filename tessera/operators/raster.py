"""Raster operators on chips whose pixels are arrays: labelling, area filters, erosion, augmentation, padding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import kernels as K
from tessera.operators import shapes

_INTS, _DOUBLES = pa.int32(), pa.float64()


def labels(mask: Column, width: int) -> Column:
    """Labels (array<int>) of a mask (array<int> of 0 and 1 by rows): the least pixel of each one's component, -1 outside."""

    @F.arrow_udf("array<int>")
    def run(masks: pa.Array) -> pa.Array:
        return K.each(masks, bool, _INTS, lambda rows, m: K.label_masks(m.reshape(len(m), -1, width)).reshape(m.shape))

    return run(mask)


def sizes(label: Column) -> Column:
    """A struct (component, size) for each component of a label array, by component."""

    @F.arrow_udf("array<struct<component:int,size:int>>")
    def run(labels: pa.Array) -> pa.Array:
        found = []
        for rows, own in K.dense(labels, np.int64):
            at, component = np.nonzero(own == np.arange(own.shape[1]))  # a component is named by one of its pixels
            found.append((rows[at], component, K.component_sizes(own)[at, component]))
        row, component, size = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int),) * 3
        order = np.lexsort((component, row))
        items = pa.StructArray.from_arrays([pa.array(component[order], _INTS), pa.array(size[order], _INTS)], ["component", "size"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(len(labels) + 1)), pa.int32()), items)

    return run(label)


def keep_large(label: Column, pixel_area_m2: float, min_area_m2: float) -> Column:
    """The mask without components below the area; all of it where the area is not positive."""
    every = min_area_m2 <= 0 or pixel_area_m2 <= 0

    @F.arrow_udf("array<int>")
    def run(labels: pa.Array) -> pa.Array:
        return K.each(labels, np.int64, _INTS, lambda rows, own: (own >= 0) if every else (own >= 0) & (K.component_sizes(own) * pixel_area_m2 >= min_area_m2))

    return run(label)


def threshold_counts(p: Column, target: Column, valid: Column, thresholds: tuple[float, ...]) -> Column:
    """For each of rising thresholds a struct (ordinal, tp, fp, fn) over valid pixels: one histogram of the steps that pixels reach, added up from above."""
    steps = np.array(thresholds)

    @F.arrow_udf("array<struct<ordinal:int,tp:long,fp:long,fn:long>>")
    def run(ps: pa.Array, targets: pa.Array, valids: pa.Array) -> pa.Array:
        n, t = len(ps), len(thresholds)
        reached, positives = np.zeros((2, n, t), np.int64), np.zeros((n, 1), np.int64)
        for (rows, own), (_, truth), (_, good) in zip(K.dense(ps, float), K.dense(targets, np.int64), K.dense(valids, np.int64), strict=True):
            at = np.arange(len(own))[:, None] * (t + 1) + np.searchsorted(steps, own, "right")
            for k in (0, 1):
                mark = (truth == k) & (good == 1)
                counts = np.bincount(at[mark], minlength=len(own) * (t + 1)).reshape(-1, t + 1)
                reached[k][rows] = counts[:, ::-1].cumsum(1)[:, ::-1][:, 1:]
                if k:
                    positives[rows, 0] = mark.sum(1)
        fields = [np.tile(np.arange(t, dtype=np.int32), n), reached[1].ravel(), reached[0].ravel(), (positives - reached[1]).ravel()]
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * t), pa.StructArray.from_arrays([pa.array(x) for x in fields], ["ordinal", "tp", "fp", "fn"]))

    return run(p, target, valid)


def component_counts(p: Column, target: Column, valid: Column, thresholds: tuple[float, ...], width: int) -> Column:
    """For each threshold a struct (ordinal, positives, components): set pixels of the truth, and (size, tp, fp) of each component.

    Counts are over valid pixels, sizes over all. Whatever is asked of any area filter is a sum over these.
    """

    def some(ps: pa.Array, targets: pa.Array, valids: pa.Array) -> pa.Array:
        n, t = len(ps), len(thresholds)
        cell, numbers = [], []
        positives = np.zeros(n, np.int64)
        for (rows, own), (_, truth), (_, good) in zip(K.dense(ps, float), K.dense(targets, np.int64), K.dense(valids, np.int64), strict=True):
            size = own.shape[1]
            if not size:
                continue
            positives[rows] = ((truth == 1) & (good == 1)).sum(1)
            for k, threshold in enumerate(thresholds):
                label = K.label_masks((own >= threshold).reshape(len(own), -1, width)).reshape(own.shape)
                on = label >= 0
                at = (label + np.arange(len(own))[:, None] * size)[on]
                counts = [np.bincount(at[mark[on]], minlength=own.size) for mark in (on, (truth == 1) & (good == 1), (truth == 0) & (good == 1))]
                some = np.flatnonzero(counts[0])
                cell.append(rows[some // size] * t + k)
                numbers.append(np.stack([c[some] for c in counts]))
        at = np.concatenate(cell) if cell else np.empty(0, np.int64)
        by = np.argsort(at, kind="stable")
        flat = (np.concatenate(numbers, 1) if numbers else np.empty((3, 0), np.int64))[:, by]
        components = pa.ListArray.from_arrays(pa.array(np.searchsorted(at[by], np.arange(n * t + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(x, _INTS) for x in flat], ["size", "tp", "fp"]))
        cells = pa.StructArray.from_arrays([pa.array(np.tile(np.arange(t), n), _INTS), pa.array(np.repeat(positives, t), _INTS), components], ["ordinal", "positives", "components"])
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * t, pa.int32()), cells)

    @F.arrow_udf("array<struct<ordinal:int,positives:int,components:array<struct<size:int,tp:int,fp:int>>>>")
    def run(ps: pa.Array, targets: pa.Array, valids: pa.Array) -> pa.Array:
        return K.by_rows(some, ps, targets, valids)

    return run(p, target, valid)


def erode(mask: Column, width: int, height: int, k: int = 1) -> Column:
    """Erosion by a square of 2 k + 1; what is outside the image is background."""

    @F.arrow_udf("array<int>")
    def run(masks: pa.Array) -> pa.Array:
        return K.each(masks, np.int64, _INTS, lambda rows, m: K.eroded(m.reshape(len(m), height, width), k).reshape(m.shape))

    return run(mask)


def _turned(dtype, kind: pa.DataType, height: int, width: int, values: pa.Array, *how: pa.Array) -> pa.Array:
    flip_h, flip_v, turns = (x.cast(pa.int64()).to_numpy(zero_copy_only=False) for x in how)
    if height != width:
        turns = turns // 2 * 2  # a quarter turn would swap the sides, so only half turns are left

    def turn(rows: np.ndarray, own: np.ndarray) -> np.ndarray:
        code = (flip_h[rows] * 2 + flip_v[rows]) * 4 + turns[rows] % 4
        out = np.empty_like(own)
        for c in np.unique(code).tolist():
            out[code == c] = own[code == c][:, K.turned_index(height, width, bool(c >> 3), bool(c >> 2 & 1), c & 3)]
        return out

    return K.each(values, dtype, kind, turn)


def d4(values: Column, side: int, flip_h: Column, flip_v: Column, turns: Column) -> Column:
    """Flips and quarter turns (counter-clockwise, after the flips) of a square chip (array<int>)."""

    @F.arrow_udf("array<int>")
    def run(values: pa.Array, flip_h: pa.Array, flip_v: pa.Array, turns: pa.Array) -> pa.Array:
        return _turned(np.int64, _INTS, side, side, values, flip_h, flip_v, turns)

    return run(values, flip_h, flip_v, turns)


def augment(image: Column, mask: Column, valid: Column, height: int, width: int, flip_h: Column, flip_v: Column, turns: Column) -> Column:
    """A struct (image, mask, valid) of a chip, one band, turned together; a chip that isn't square makes half turns only (0 or 2)."""

    @F.arrow_udf("struct<image:array<double>,mask:array<int>,valid:array<int>>")
    def run(image: pa.Array, mask: pa.Array, valid: pa.Array, *how: pa.Array) -> pa.Array:
        parts = [_turned(dtype, kind, height, width, x, *how) for x, dtype, kind in ((image, float, _DOUBLES), (mask, np.int64, _INTS), (valid, np.int64, _INTS))]
        return pa.StructArray.from_arrays(parts, ["image", "mask", "valid"])

    return run(image, mask, valid, flip_h, flip_v, turns)


def jitter(values: Column, factor: Column) -> Column:
    """Brightness: values times a factor, clamped to 0 and 1."""
    return F.transform(values, lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v * factor)))


def pad_to(values: Column, h: Column, w: Column, to_h: Column, to_w: Column) -> Column:
    """Zeros to the right and below up to a size (array<double>)."""

    @F.arrow_udf("array<double>")
    def run(values: pa.Array, *sides: pa.Array) -> pa.Array:
        size = np.stack([x.to_numpy(zero_copy_only=False).astype(np.int64) for x in sides], 1)
        flat, begins = values.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        out = []
        for own in np.unique(size, axis=0):
            rows = np.flatnonzero((size == own).all(1))
            h, w, to_h, to_w = own.tolist()
            padded = np.zeros((len(rows), to_h, to_w))
            padded[:, :h, :w] = flat[begins[rows][:, None] + np.arange(h * w)].reshape(-1, h, w)
            out.append((rows, padded.reshape(len(rows), -1)))
        return K.lists(len(values), out, _DOUBLES)

    return run(values, h, w, to_h, to_w)


def pad_multiple(n: Column, multiple: int) -> Column:
    return F.pmod(-n, F.lit(multiple))


def resample(values: Column, width: int, rows: np.ndarray, cols: np.ndarray) -> Column:
    """Chips (array<double>) read at fractional pixel centres by bilinear weights, 0 outside; rows and cols are the target grid's."""

    @F.arrow_udf("array<double>")
    def run(values: pa.Array) -> pa.Array:
        return K.each(values, float, _DOUBLES, lambda _, own: K.bilinear(own.reshape(len(own), -1, width), rows, cols).reshape(len(own), -1))

    return run(values)


def reproject(values: Column, width: int, box: Column, to_width: Column, to_height: Column) -> Column:
    """Chips (array<double>) that cover a box (w, s, e, n) in degrees, read by bilinear weights on the Mercator grid of the same bounds; each area has its own.

    A target pixel takes the value at its centre; 0 where that lies outside the centres of the outer source pixels.
    """

    @F.arrow_udf("array<double>")
    def run(values: pa.Array, boxes: pa.Array, *sizes: pa.Array) -> pa.Array:
        w, s, e, n = (boxes.field(c).to_numpy(zero_copy_only=False) for c in "wsen")
        to_w, to_h = (x.to_numpy(zero_copy_only=False) for x in sizes)
        out: list = [None] * len(values)
        for rows, own in K.dense(values, float):
            for k, chip in zip(rows.tolist(), own.reshape(len(rows), -1, width) if own.shape[1] else own, strict=True):
                if not chip.size:
                    out[k] = []
                    continue
                x0, x1 = np.radians(w[k]), np.radians(e[k])
                y0, y1 = np.log(np.tan(np.pi / 4 + np.radians(s[k]) / 2)), np.log(np.tan(np.pi / 4 + np.radians(n[k]) / 2))
                lon = np.degrees(x0 + (np.arange(to_w[k]) + 0.5) * ((x1 - x0) / to_w[k]))
                lat = np.degrees(2 * np.arctan(np.exp(y1 - (np.arange(to_h[k]) + 0.5) * ((y1 - y0) / to_h[k]))) - np.pi / 2)
                cols, lines = (lon - w[k]) / (e[k] - w[k]) * chip.shape[1] - 0.5, (n[k] - lat) / (n[k] - s[k]) * chip.shape[0] - 0.5
                out[k] = K.bilinear(chip[None], *np.meshgrid(lines, cols, indexing="ij"))[0].ravel()
        return pa.array(out, pa.list_(pa.float64()))

    return run(values, box, to_width, to_height)


def normalised(bands: Column) -> Column:
    """The first three bands over 255; missing bands are 0."""
    return F.slice(F.concat(F.transform(bands, lambda b: b / 255.0), F.array_repeat(F.lit(0.0), 3)), 1, 3)


def confusion_class(target: Column, predicted: Column, valid: Column) -> Column:
    return F.when(valid == 0, "invalid").when((target == 1) & (predicted == 1), "tp").when(predicted == 1, "fp").when(target == 1, "fn").otherwise("tn")


def inside_polygon(xs: Column, ys: Column, x: Column, y: Column) -> Column:
    """Whether a point is in a ring (even-odd rule); xs and ys are the ring's corners in order."""
    n = F.size(xs)

    def crosses(i: Column) -> Column:
        j = F.pmod(i + 1, n).cast("int")
        xi, yi, xj, yj = F.get(xs, i), F.get(ys, i), F.get(xs, j), F.get(ys, j)
        return F.when((yi > y) != (yj > y), (x < (xj - xi) * (y - yi) / F.when(yj == yi, F.lit(1.0)).otherwise(yj - yi) + xi).cast("int")).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), crosses), F.lit(0), lambda a, b: a + b) % 2 == 1


def ring_spans(polygons: DataFrame, area: str, polygon: str, rings: str, height: int, width: int, band: int = 64) -> DataFrame:
    """(area, polygon, row, begin, end) of the pixels whose centres lie in polygons, by the even-odd rule; rings are corners [column, row] in pixels.

    Sides are dealt to the bands of ``band`` rows that they pass and meet by polygon and band, so neither a
    large ring nor an area of many rings is one task. Null and empty rings burn nothing.
    """
    ring = polygons.select(F.col(area).alias("area"), F.col(polygon).alias("polygon"), F.explode(rings).alias("ring"))
    after = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    sides = ring.where(F.size("ring") > 0).select("area", "polygon", F.explode(F.zip_with("ring", after, lambda a, b: F.struct(a[0].alias("x"), a[1].alias("y"), b[0].alias("x2"), b[1].alias("y2")))).alias("s"))
    y, y2 = F.col("s.y"), F.col("s.y2")
    low, high = F.greatest(F.ceil(F.least(y, y2) - 0.5), F.lit(0)), F.least(F.ceil(F.greatest(y, y2) - 0.5), F.lit(height)) - 1
    dealt = sides.withColumns({"low": low, "high": high}).where("low <= high").withColumn("band", F.explode(F.sequence(F.floor(F.col("low") / band), F.floor(F.col("high") / band))))

    @F.arrow_udf("array<struct<row:int,begin:int,end:int>>")
    def run(own: pa.Array, bands: pa.Array) -> pa.Array:
        of = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy(zero_copy_only=False))
        first = bands.to_numpy(zero_copy_only=False)[of] * band
        flat = own.flatten()
        found = shapes.spans(*[flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "x2", "y2")], first, np.minimum(first + band, height), width, of)
        ends = np.searchsorted(found[0], np.arange(len(own) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in found[1:]], ["row", "begin", "end"]))

    met = dealt.groupBy("area", "polygon", "band").agg(F.collect_list("s").alias("sides"))
    return met.select("area", "polygon", F.explode(run(F.col("sides"), F.col("band"))).alias("z")).select("area", "polygon", "z.*")


def merged_spans(spans: DataFrame) -> DataFrame:
    """(area, row, begin, end) without overlaps: what each span adds to those that begin before it in its row."""
    before = Window.partitionBy("area", "row").orderBy("begin", "end", "polygon").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("begin", F.greatest("begin", F.coalesce(F.max("end").over(before), F.lit(0)))).where("begin < end").select("area", "row", "begin", "end")
