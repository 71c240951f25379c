"""TIFF and PNG bytes that come back, and how much of a file a window reads."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import images
from tessera.sources import images as files


@pytest.mark.parametrize("shape,tile,dtype", [((40, 70, 3), 16, np.uint8), ((16, 16, 1), 16, np.uint8), ((33, 5, 4), 32, np.uint16), ((1, 1, 2), 16, np.uint16)])
def test_tiff_comes_back(shape, tile, dtype):
    image = np.random.default_rng(1).integers(0, np.iinfo(dtype).max + 1, shape).astype(dtype)
    data = images.encode_tiff(image, tile, (1.0, 2.0, 1.0 + shape[1] * 0.5, 2.0 + shape[0] * 0.25), 4326)
    asked = []

    def read(at, n):
        asked.append((at, n))
        return data[at : at + n]

    tiff = images.Tiff.open(read)
    assert tiff.shape == shape and tiff.epsg == 4326 and tiff.bounds == (1.0, 2.0, 1.0 + shape[1] * 0.5, 2.0 + shape[0] * 0.25)
    assert (tiff.window(0, 0, *shape[:2]) == image).all() and tiff.window(0, 0, 1, 1).dtype == dtype
    asked.clear()
    r, c = shape[0] // 2, shape[1] // 2
    assert (tiff.window(r, c, r + 1, c + 1) == image[r : r + 1, c : c + 1]).all() and len(asked) == 1
    with pytest.raises(ValueError, match="no window"):
        tiff.window(0, 0, shape[0] + 1, 1)


def test_what_tiff_cannot_read_is_told():
    with pytest.raises(ValueError, match="little-endian"):
        images.Tiff.open(images.of_bytes(b"MM\0*" + b"\0" * 9))
    with pytest.raises(ValueError):
        images.encode_tiff(np.zeros((2, 2), np.uint8))
    with pytest.raises(ValueError):
        images.encode_tiff(np.zeros((2, 2, 1), np.uint8), 20)


def filtered(image, kinds):
    """Rows by the format's own definition of its filters."""
    h, w, step = image.shape
    flat = image.reshape(h, -1).astype(int)
    rows = b""
    for r in range(h):
        up, out = flat[r - 1] if r else np.zeros(w * step, int), []
        for i in range(w * step):
            a, b, c = (flat[r][i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
            p = a + b - c
            paeth = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            out.append((flat[r][i] - (0, a, b, (a + b) // 2, paeth)[kinds[r]]) % 256)
        rows += bytes([kinds[r], *out])
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    packed = zlib.compress(rows)
    kind = {1: 0, 3: 2, 2: 4, 4: 6}[step]
    return images.PNG_MARK + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", packed[:5]) + part(b"IDAT", packed[5:]) + part(b"IEND", b"")


@pytest.mark.parametrize("step", [1, 2, 3, 4])
def test_png_filters_are_undone(step):
    image = np.random.default_rng(step).integers(0, 256, (10, 7, step)).astype(np.uint8)
    assert (images.decode_png(filtered(image, [k % 5 for k in range(10)])) == image).all()
    assert (images.decode_png(filtered(image, [4 - k % 5 for k in range(10)])) == image).all()
    assert (images.decode_png(images.encode_png(image)) == image).all()
    with pytest.raises(ValueError, match="broken"):
        images.decode_png(images.encode_png(image).replace(b"IEND", b"IENX"))
    with pytest.raises(ValueError, match="not a PNG"):
        images.decode_png(b"GIF")


def test_files_of_a_folder(spark, tmp_path):
    rows = [(f"k{k}", [(k * 7 + i) % 256 for i in range(3 * 20 * 40)], 20, 40, 3, 0.0, 0.0, 4.0, 2.0) for k in range(5)]
    files.write_images(spark.createDataFrame(rows, "key string, values array<int>, height int, width int, bands int, w double, s double, e double, n double"), str(tmp_path / "tif"), 16, 3857)
    assert sorted(p.name for p in (tmp_path / "tif").iterdir()) == [f"k{k}.tif" for k in range(5)]
    wanted = spark.createDataFrame([(str(tmp_path / "tif" / f"k{k}.tif"), 3, 5, 18, 30) for k in range(5)], "path string, row int, col int, last_row int, last_col int")
    for r in files.read_windows(wanted).collect():
        k = int(r["path"][-5])
        whole = np.array(rows[k][1]).reshape(20, 40, 3)
        assert r["values"] == whole[3:18, 5:30].ravel().tolist() and (r["height"], r["width"], r["bands"], r["e"], r["epsg"]) == (15, 25, 3, 4.0, 3857)
    image = np.arange(60, dtype=np.uint8).reshape(4, 5, 3)
    (tmp_path / "png").mkdir()
    (tmp_path / "png" / "a.png").write_bytes(images.encode_png(image))
    row = files.read_pngs(spark, str(tmp_path / "png")).first()
    assert row["values"] == image.ravel().tolist() and row["width"] == 5
    got = spark.createDataFrame([([1, 2, 3, 4], 2, 2, 1), (None, 1, 1, 1)], "v array<int>, h int, w int, b int").select(files.tiff_bytes(F.col("v"), F.col("h"), F.col("w"), F.col("b"), 16).alias("t")).collect()
    assert images.Tiff.open(images.of_bytes(bytes(got[0]["t"]))).window(0, 0, 2, 2).ravel().tolist() == [1, 2, 3, 4] and got[1]["t"] is None
