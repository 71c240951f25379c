"""What the operators of this subpackage share: reading tables, durable intermediate tables, random keys."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.kernels import bound_batches as bound_batches

#: A word of a text; ASCII white space separates words and nothing else does.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``; on one machine, where it is unset, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def _write(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back, which cuts the lineage.

    Lost executors cost nothing that was written. Within ``settle`` the table goes when that is done;
    elsewhere it stays until the folder is emptied, as Spark's own checkpoints do.
    """
    out, path = _write(df)
    if (own := _scratch.get()) is not None:
        own.append(path)
    return out


def drop(df: DataFrame) -> None:
    """Deletes the folders of a table that ``materialize`` made, once nothing reads it any more."""
    _delete(df.sparkSession, [f.rsplit("/", 1)[0] for f in df.inputFiles()])


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the files of shuffles whose results are written: it does so once neither Python nor the JVM holds their plans.

    The listeners hold the last query until another one comes, so one comes.
    """
    spark.range(1).count()
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in set(paths):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def settle(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build()`` returns, written; all that it materialised on the way is deleted then, or when it fails."""
    own: list[str] = []
    token = _scratch.set(own)
    try:
        out, path = _write(build())
    finally:
        _scratch.reset(token)
        _delete(spark, own)
        forget_shuffles(spark)
    if (outer := _scratch.get()) is not None:
        outer.append(path)
    return out


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most_rows`` rows, else as it is.

    ``df`` must be cheap to recompute (a materialised table).
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def random_bits(*parts: Column | str | int) -> Column:
    """A long from 0 to 2^52 - 1 that depends on the parts alone; nulls count as a value of their own."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def fraction(bits: Column) -> Column:
    """``random_bits`` as a double strictly between 0 and 1."""
    return (bits.cast("double") + 0.5) / float(1 << 52)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
