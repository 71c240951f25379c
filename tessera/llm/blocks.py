"""Corpus-wide lookups of hashes by blocks of documents.

Counting every n-gram of a corpus row by row would shuffle a row for each word. Here documents are
packed into blocks; a block asks once for each distinct hash it holds. Requests are dealt by ranges
of the hash, so that each range meets the same hash of all blocks, and the replies return in the
order of the block's sorted hashes. Sorted hashes travel as differences, and all numbers as byte
planes, compressed. Nothing is gathered but one range or one block at a time; both have a bounded
share of the data, and a hash that is everywhere is one entry of each block's request.

A first question may take the leading bits of a hash only, as many as the text's size asks for: a
few more n-grams seem to recur, none fewer, and each bit less is a bit less to send. A block has a
row for each range, so ``block_bytes`` and ``range_bytes`` should grow with the executors' memory
where the text is very large: rows are text / block_bytes * text / range_bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as T
from tessera.llm.common import bound_batches, materialize

#: The order of a null id: behind all others.
NULL_ID = np.iinfo(np.int64).max
BLOCK_BYTES = 4 << 20
BLOCKS = "block long, n int, ids array<long>, lengths array<long>, body binary"
REQUESTS = "bucket int, block long, hashes binary, numbers array<binary>"
REPLIES = "block long, bucket int, hashes binary, numbers array<binary>"
RANGE_BYTES = 12 << 20


def shut(numbers: np.ndarray, rising: bool = False) -> bytes:
    """64-bit numbers as compressed planes of bytes; ``rising`` ones as differences."""
    x = numbers.astype(np.int64) if numbers.dtype != np.uint64 else numbers.view(np.int64)
    if rising and len(x):
        x = np.concatenate([x[:1], x[1:] - x[:-1]])
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def opened(blob: bytes, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    x = np.ascontiguousarray(planes.T).view(np.int64).ravel()
    return np.cumsum(x) if rising else x.copy()


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A written table of blocks: ids and lengths of some documents by rising id, and their texts, compressed.

    A null text is empty, a null id stays null and comes last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            order = batch.column("key").fill_null(NULL_ID).to_numpy().argsort(kind="stable")
            ids, texts = batch.column("key").take(pa.array(order)), batch.column("text").take(pa.array(order))
            data, at = T.raw(texts)
            for low, high in T.pieces(at, block_bytes):
                body = zstandard.ZstdCompressor(level=5).compress(data[at[low] : at[high]].tobytes())
                own = [[x] for x in (block, high - low, ids[low:high].to_pylist(), np.diff(at[low : high + 1]).tolist(), body)]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(own, [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()], strict=True)], ["block", "n", "ids", "lengths", "body"])
                block += 1
        T.release()

    bound_batches(docs.sparkSession)
    return materialize(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, BLOCKS))


def unpack(row: dict) -> tuple[np.ndarray, T.Words]:
    """(ids with NULL_ID for null, words) of a block."""
    ids = np.array([NULL_ID if x is None else x for x in row["ids"]], np.int64)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"]), np.uint8)
    return ids, T.split_words(data, np.concatenate([[0], np.cumsum(row["lengths"])]).astype(np.int64))


@dataclass(frozen=True)
class Scale:
    """What hangs on the size of all texts: the number of ranges, and how many bits tell their n-grams apart."""

    buckets: int
    bits: int

    def leading(self, spare: int) -> np.uint64:
        """Keeps as many leading bits as there are n-grams, and ``spare`` more: unequal n-grams agree in them with a chance of 2 ** -spare."""
        return np.uint64((1 << 64) - (1 << max(0, 64 - self.bits - spare)))


def scale_of(blocks: DataFrame, range_bytes: int = RANGE_BYTES, least: int = 96) -> Scale:
    """One range of hashes for each ``range_bytes`` of text."""
    total = blocks.select(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    return Scale(max(least, total // range_bytes), max(1, total).bit_length())


#: From a block's row: its sorted hashes, distinct but where numbers tell them apart, and numbers for each of them.
Ask = Callable[[dict], tuple[np.ndarray, list[np.ndarray]]]
#: From the hashes of all blocks in one range, sorted, with the blocks' numbers in the same order:
#: the replies in that order.
Answer = Callable[[np.ndarray, list[np.ndarray]], list[np.ndarray]]


def replies(blocks: DataFrame, ask: Ask, answer: Answer, buckets: int, hits: bool = False) -> DataFrame:
    """(of, replies) of each block that asked: what ``answer`` says about each hash for which ``ask`` asked, by range.

    ``hits``: the first of the replies says which hashes get one at all; only they return, with their hashes.
    """

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                hashes, numbers = ask(batch.slice(k, 1).to_pylist()[0])
                block = batch.column("block")[k].as_py()
                of = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                cuts = np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))
                own = [(b, int(cuts[b]), int(cuts[b + 1])) for b in range(buckets) if cuts[b] < cuts[b + 1]]
                if own:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([b for b, _, _ in own], pa.int32()),
                            pa.array([block] * len(own), pa.int64()),
                            pa.array([shut(hashes[i:j], True) for _, i, j in own], pa.binary()),
                            pa.array([[shut(x[i:j]) for x in numbers] for _, i, j in own], pa.list_(pa.binary())),
                        ],
                        ["bucket", "block", "hashes", "numbers"],
                    )
        T.release()

    def answering(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [opened(r["hashes"], True).view(np.uint64) for r in rows]
        numbers = [np.concatenate(x) for x in zip(*[[opened(b) for b in r["numbers"]] for r in rows], strict=True)]
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        hashes = np.concatenate(parts)
        order = np.argsort(hashes, kind="stable")
        parted = []
        for sorted_reply in answer(hashes[order], [x[order] for x in numbers]):
            reply = np.empty(len(order), np.int64)
            reply[order] = sorted_reply
            parted.append(np.split(reply, cuts))
        out: dict[str, list] = {"block": [], "bucket": [], "hashes": [], "numbers": []}
        for k, r in enumerate(rows):
            hit = parted[0][k].astype(bool) if hits else None
            if hit is None or hit.any():
                out["block"].append(r["block"])
                out["bucket"].append(r["bucket"])
                out["hashes"].append(None if hit is None else shut(parts[k][hit], True))
                out["numbers"].append([shut(x[k]) for x in parted] if hit is None else [shut(x[k][hit]) for x in parted[1:]])
        T.release()
        return pa.table({name: pa.array(v, t) for (name, v), t in zip(out.items(), [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.binary())], strict=True)})

    said = blocks.mapInArrow(asking, REQUESTS).groupBy("bucket").applyInArrow(answering, REPLIES)
    return said.groupBy(F.col("block").alias("of")).agg(F.array_sort(F.collect_list(F.struct("bucket", "hashes", "numbers"))).alias("replies"))


def with_replies(blocks: DataFrame, said: DataFrame) -> DataFrame:
    return blocks.join(said, F.col("block") == F.col("of"), "left").drop("of")


def ask_and_answer(blocks: DataFrame, ask: Ask, answer: Answer, buckets: int) -> DataFrame:
    """``blocks`` with the ``replies`` to their questions."""
    return with_replies(blocks, replies(blocks, ask, answer, buckets))


def replies_of(row: dict, kinds: int) -> list[np.ndarray]:
    """The replies of a block, in the order of its sorted hashes."""
    if not row["replies"]:
        return [np.empty(0, np.int64)] * kinds
    return [np.concatenate([opened(r["numbers"][k]) for r in row["replies"]]) for k in range(kinds)]


def hits_of(row: dict, kinds: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sorted hashes of a block that got a reply, and these."""
    if not row["replies"]:
        return np.empty(0, np.uint64), [np.empty(0, np.int64)] * kinds
    return np.concatenate([opened(r["hashes"], True).view(np.uint64) for r in row["replies"]]), replies_of(row, kinds)


def map_blocks(blocks: DataFrame, fn: Callable[[dict], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """The record batches that ``fn`` makes of each block's row, one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for row in batch.slice(k, 1).to_pylist():
                    yield from fn(row)
        T.release()

    return blocks.mapInArrow(run, schema)
