"""Image files as rows: TIFF written to a folder, windows of them read by their tiles, PNG decoded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import images

WINDOW = "path string, height int, width int, bands int, row int, col int, w double, s double, e double, n double, epsg int, values array<int>"


def tiff_bytes(values: Column, height: Column, width: Column, bands: Column, tile: int = 256) -> Column:
    """A TIFF of each image: whole numbers from 0 to 255 by rows, a pixel's bands together; null for null values."""

    @F.arrow_udf("binary")
    def run(values: pa.Array, *sizes: pa.Array) -> pa.Array:
        h, w, b = (x.to_pylist() for x in sizes)
        return pa.array([None if v is None else images.encode_tiff(np.array(v, np.uint8).reshape(h[k], w[k], b[k]), tile) for k, v in enumerate(values.to_pylist())], pa.binary())

    return run(values, height, width, bands)


def write_images(rows: DataFrame, path: str, tile: int = 256, epsg: int | None = None) -> None:
    """A TIFF file ``key.tif`` in the folder for each row (key, values, height, width, bands, w, s, e, n), written by the tasks; a file is complete or not there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                fs, at = pyarrow.fs.FileSystem.from_uri(path) if ":" in path else (pyarrow.fs.LocalFileSystem(), path)
                fs.create_dir(at, recursive=True)
                whole = images.encode_tiff(np.array(r["values"], np.uint8).reshape(r["height"], r["width"], r["bands"]), tile, (r["w"], r["s"], r["e"], r["n"]), epsg)
                with fs.open_output_stream(f"{at}/.{r['key']}.part") as f:
                    f.write(whole)
                fs.move(f"{at}/.{r['key']}.part", f"{at}/{r['key']}.tif")
                done.append(len(whole))
            yield pa.RecordBatch.from_pydict({"bytes": pa.array(done, pa.int64())})

    rows.select("key", "values", "height", "width", "bands", "w", "s", "e", "n").mapInArrow(run, "bytes long").agg(F.sum("bytes")).collect()


def read_windows(wanted: DataFrame) -> DataFrame:
    """The window of each file (path, row, col, last_row, last_col), read by its directory and the tiles that it meets; null ends are the image's. See WINDOW."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, at = pyarrow.fs.FileSystem.from_uri(r["path"]) if ":" in r["path"] else (pyarrow.fs.LocalFileSystem(), r["path"])
                with fs.open_input_file(at) as f:
                    tiff = images.Tiff.open(lambda offset, n, f=f: f.read_at(n, offset))
                    last = [tiff.shape[k] if r[c] is None else r[c] for k, c in enumerate(("last_row", "last_col"))]
                    own = tiff.window(r["row"], r["col"], *last)
                    w, s, e, n = tiff.bounds or (None,) * 4
                one = {"path": r["path"], **dict(zip(("height", "width", "bands"), own.shape, strict=True)), "row": r["row"], "col": r["col"], "w": w, "s": s, "e": e, "n": n, "epsg": tiff.epsg, "values": own.ravel().tolist()}
                kinds = [("path", pa.string()), *[(c, pa.int32()) for c in ("height", "width", "bands", "row", "col")], *[(c, pa.float64()) for c in "wsen"], ("epsg", pa.int32()), ("values", pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_pylist([one], pa.schema(kinds))

    return wanted.select("path", "row", "col", "last_row", "last_col").mapInArrow(run, WINDOW)


def read_pngs(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, bands, values) of PNG files."""

    @F.arrow_udf("struct<height:int,width:int,bands:int,values:array<int>>")
    def run(content: pa.Array) -> pa.Array:
        found = [images.decode_png(x) for x in content.to_pylist()]
        rows = [dict(zip(("height", "width", "bands"), x.shape, strict=True)) | {"values": x.ravel().tolist()} for x in found]
        return pa.array(rows, pa.struct([*[(c, pa.int32()) for c in ("height", "width", "bands")], ("values", pa.list_(pa.int32()))]))

    return spark.read.format("binaryFile").load(path).select("path", run("content").alias("z")).select("path", "z.*")
