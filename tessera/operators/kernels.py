"""Arrow kernels on arrays of pixels: batches of equally long arrays become one numpy array and back.

Spark deals the chips; a kernel sees one Arrow batch and does the same steps for all chips of a size
at once. No kernel looks at one pixel after the other in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession


def bound_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> None:
    """Bounds the Arrow batches that this session hands to Python workers, unless they are bounded more tightly.

    A batch, what is made of it and its reply are in memory at once in every worker of an executor, and
    ten thousand rows have no bound. A single row is never cut.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = spark.conf.get(name).lower().removesuffix("b")
    if not found.isdigit() or not 0 < int(found) <= most_bytes:
        spark.conf.set(name, str(most_bytes))


#: Rows of a batch that a kernel turns into its result at once.
ROWS = 512


def by_rows(fn: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """``fn`` over ``ROWS`` rows after the other, put together, so that what is made on the way doesn't grow with the batch."""
    return pa.concat_arrays([fn(*(c.slice(k, ROWS) for c in columns)) for k in range(0, max(len(columns[0]), 1), ROWS)])


def dense(arrays: pa.Array, dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, values) for each length: which rows of ``arrays`` have it, and their values as a matrix. Null arrays count as empty."""
    lengths = arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = arrays.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    begins = np.cumsum(lengths) - lengths
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        yield rows, flat[begins[rows][:, None] + np.arange(size)]


def lists(n: int, parts: list[tuple[np.ndarray, np.ndarray]], kind: pa.DataType) -> pa.Array:
    """``n`` lists from (rows, matrix of their values)."""
    lengths = np.zeros(n, np.int64)
    for rows, values in parts:
        lengths[rows] = values.shape[1]
    ends = np.cumsum(lengths)
    flat = np.empty(ends[-1] if n else 0, kind.to_pandas_dtype())
    for rows, values in parts:
        flat[(ends - lengths)[rows][:, None] + np.arange(values.shape[1])] = values
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat, kind))


def each(arrays: pa.Array, dtype, kind: pa.DataType, fn: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pa.Array:
    """``fn(rows, values)`` of each length, put together as lists; empty arrays stay empty."""
    return lists(len(arrays), [(rows, fn(rows, values) if values.shape[1] else values) for rows, values in dense(arrays, dtype)], kind)


def label_masks(masks: np.ndarray) -> np.ndarray:
    """4-connected components of many masks (n, h, w): each set pixel gets the least pixel index of its component, others -1.

    Roots hook onto the least root beside them and paths are halved, so that the rounds grow with the
    logarithm of a component's longest path.
    """
    n, h, w = masks.shape
    masks = masks.astype(bool)
    index = np.arange(n * h * w).reshape(n, h, w)
    right, down = masks[:, :, 1:] & masks[:, :, :-1], masks[:, 1:] & masks[:, :-1]
    a = np.concatenate([index[:, :, :-1][right], index[:, :-1][down]])
    b = np.concatenate([index[:, :, 1:][right], index[:, 1:][down]])
    root = index.ravel().copy()
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        if not apart.any():
            break
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return np.where(masks, root.reshape(n, h, w) - index[:, :1, :1], -1)


def component_sizes(label: np.ndarray) -> np.ndarray:
    """The pixels of the component of each label of a matrix of labels, 0 where there is none."""
    n, size = label.shape
    at = np.where(label >= 0, label + np.arange(n)[:, None] * size, n * size)
    return np.where(label >= 0, np.bincount(at.ravel(), minlength=n * size + 1)[at], 0)


def eroded(masks: np.ndarray, k: int) -> np.ndarray:
    """Erosion of masks (n, h, w) by a square of 2 k + 1; outside the image is background. One axis after the other."""
    out = np.pad(masks == 1, ((0, 0), (k, k), (k, k)))
    n, h, w = masks.shape
    rows = np.logical_and.reduce([out[:, j : j + h] for j in range(2 * k + 1)])
    return np.logical_and.reduce([rows[:, :, j : j + w] for j in range(2 * k + 1)])


def turned_index(h: int, w: int, flip_h: bool, flip_v: bool, turns: int) -> np.ndarray:
    """Where each pixel of a turned chip comes from: flips, then quarter turns counter-clockwise."""
    at = np.arange(h * w).reshape(h, w)
    at = at[:, ::-1] if flip_h else at
    at = at[::-1] if flip_v else at
    return np.rot90(at, turns).ravel()


def bilinear(image: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Values of images (n, h, w) at fractional pixel centres; outside them 0."""
    _, h, w = image.shape
    inside = (rows >= 0) & (rows <= h - 1) & (cols >= 0) & (cols <= w - 1)
    r, c = np.clip(rows, 0, h - 1), np.clip(cols, 0, w - 1)
    r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
    r1, c1 = np.minimum(r0 + 1, h - 1), np.minimum(c0 + 1, w - 1)
    fr, fc = r - r0, c - c0
    mixed = image[:, r0, c0] * (1 - fr) * (1 - fc) + image[:, r0, c1] * (1 - fr) * fc + image[:, r1, c0] * fr * (1 - fc) + image[:, r1, c1] * fr * fc
    return np.where(inside, mixed, 0)
