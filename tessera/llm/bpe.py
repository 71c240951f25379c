"""Byte-level BPE encoding and decoding, by DuckDB's recursive queries inside Spark's tasks.

Each task splits its texts by the tokenizer's pattern and hands the words that are new to it to a
recursive query: the rows of token positions join the merge table, and each word contracts its
leftmost pair of the least rank until no pair is left. Words recur, so a worker keeps what it has
encoded, up to a bound. Decoding joins token positions with the vocabulary and concatenates the
bytes of a document by an ordered aggregation.
"""

from __future__ import annotations

import base64
import heapq
import re
import tempfile
import zlib
from collections.abc import Iterator
from functools import cache

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from tessera.llm import text as T
from tessera.llm.common import bound_batches, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Words of more bytes are contracted with a heap: the recursion handles the whole word for each merge.
LONG_WORD = 256
#: When a worker keeps so many words, at some 50 bytes each, it drops those that did not come again.
MOST_KEPT = 1_000_000
#: Tokens that one decoding query takes.
DECODED_AT_ONCE = 300_000

_CONTRACT = """
WITH RECURSIVE step(w, t) AS (
  SELECT w, t FROM words
  UNION ALL
  SELECT s.w, list_concat(list_concat(s.t[:best.at - 1], [best.merged]), s.t[best.at + 2:])
  FROM step s JOIN (
    SELECT w, (min(key) >> 32)::INTEGER AS merged, (min(key) & 4294967295)::INTEGER AS at
    FROM (
      SELECT p.w, (m.merged::BIGINT << 32) | p.at AS key
      FROM (SELECT w, unnest(t[:-2]) AS a, unnest(t[2:]) AS b, generate_subscripts(t[2:], 1) AS at FROM step WHERE len(t) > 1) p
      JOIN merges m ON p.a = m.a AND p.b = m.b
    ) GROUP BY w
  ) best ON s.w = best.w
)
SELECT w, arg_min(t, len(t)) AS t FROM step GROUP BY w ORDER BY w
"""
_DECODE = """
SELECT d, unhex(array_to_string(list(h ORDER BY pos), '')) AS b
FROM (SELECT d, unnest(t) AS t, generate_subscripts(t, 1) AS pos FROM docs) JOIN vocab USING (t)
GROUP BY d
"""


def latin_pattern(pattern: str) -> str:
    """``pattern`` for texts of code points below 256, with its classes spelled out; the standard module runs it faster."""
    chars = [chr(i) for i in range(256)]
    classes = {c: "".join(re.escape(x) for x in chars if regex.match(c, x)) for c in (r"\p{L}", r"\p{N}", r"\s")}

    def spelled(m: re.Match) -> str:
        if m[0].startswith("["):
            return re.sub(r"\\p\{[LN]\}|\\s", lambda c: classes[c[0]], m[0])
        return f"[^{classes[chr(92) + 's']}]" if m[0] == r"\S" else f"[{classes[m[0]]}]"

    return re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\[sS]", spelled, pattern)


class Tokenizer:
    """The tables of one rank file in a DuckDB connection, and the words that were encoded so far."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.narrow = re.compile(latin_pattern(pattern))
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(a, b, r) for token, r in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": tempfile.gettempdir()})
        merges = pa.table({k: pa.array([p[i] for p in pairs], pa.int32()) for i, k in enumerate(("a", "b", "merged"))})
        vocab = pa.table({"t": pa.array(list(ranks.values()), pa.int32()), "b": pa.array(list(ranks), pa.binary())})
        self.db.register("merges_in", merges)
        self.db.register("vocab_in", vocab)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_in; CREATE TABLE vocab AS SELECT t, hex(b) AS h FROM vocab_in")
        self.db.unregister("merges_in")
        self.db.unregister("vocab_in")
        self.forget()

    @cache
    def merges(self) -> dict[tuple[int, int], int]:
        """The merge table for long words; most workers never meet one."""
        return {(a, b): r for a, b, r in self.db.sql("SELECT a, b, merged FROM merges").fetchall()}

    def thin(self) -> None:
        """Drops the words that were met once since the last time; all of them where too many are left."""
        kept = np.flatnonzero(self.again)
        if len(kept) > MOST_KEPT // 2:
            return self.forget()
        flat, ends = self.gathered(self.flat, self.ends, self.rows[kept])
        self.known, self.sums, self.rows, self.flat, self.ends = self.known[kept], self.sums[kept], np.arange(len(kept)), flat, ends
        self.again = np.zeros(len(kept), bool)

    def forget(self) -> None:
        self.known = np.empty(0, np.int64)  # sorted hashes of words
        self.sums = np.empty(0, np.int64)  # their checksums, which tell words of one hash apart
        self.again = np.empty(0, bool)  # which of them came again
        self.rows = np.empty(0, np.int64)  # and where each has its tokens
        self.flat = np.empty(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.pattern.findall(text)
        return self.narrow.findall(text)

    def contract_long(self, word: bytes) -> list[int]:
        """The same as the query for one long word: least rank first, then leftmost."""
        ids: list[int] = self.bytes[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        rank = lambda i: self.merges().get((ids[i], ids[after[i]])) if after[i] < len(ids) else None
        heap = [(r, i) for i in range(len(ids)) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank(i) != r:
                continue
            gone = after[i]
            ids[i], after[i] = r, after[gone]
            if after[i] < len(ids):
                before[after[i]] = i
            ids[gone] = -1
            for k in (before[i], i):
                if k >= 0 and (n := rank(k)) is not None:
                    heapq.heappush(heap, (n, k))
        return [x for x in ids if x >= 0]

    def contract(self, words: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        lengths = np.array([len(w) for w in words], np.int64)
        # a run of the query keeps each step of each word, so its size goes with the squares of lengths
        cuts = np.cumsum(np.minimum(lengths, LONG_WORD) ** 2) // 2_000_000
        for part in np.split(np.arange(len(words)), np.flatnonzero(np.diff(cuts)) + 1):
            some = [words[i] for i in part]
            short = [w for w in some if len(w) <= LONG_WORD]
            at = np.concatenate([[0], np.cumsum([len(w) for w in short])]).astype(np.int32)
            start = self.bytes[np.frombuffer(b"".join(short), np.uint8)]
            self.db.register("words", pa.table({"w": np.arange(len(short), dtype=np.int32), "t": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(start, pa.int32()))}))
            got = self.db.sql(_CONTRACT).to_arrow_table()["t"].combine_chunks()
            flat, ends = got.flatten().to_numpy(), np.concatenate([[0], np.cumsum(got.value_lengths().to_numpy())]).astype(np.int64)
            done = iter(range(len(short)))
            for w in some:
                if len(w) <= LONG_WORD:
                    k = next(done)
                    out.append(flat[ends[k] : ends[k + 1]])
                else:
                    out.append(np.array(self.contract_long(w), np.int32))
        return out

    def encode(self, texts: list[str | None]) -> pa.Array:
        """The token ids of each text; a null text is empty."""
        if len(self.known) > MOST_KEPT:
            self.thin()
        words: list[str] = []
        begins = [0]
        for text in texts:
            words += self.words(text or "")
            begins.append(len(words))
        ids, to = self.tokens(words)
        return pa.LargeListArray.from_arrays(pa.array(to[begins], pa.int64()), pa.array(ids, pa.int32())).cast(pa.list_(pa.int32()))

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all words in their order, where each word's begin)."""
        code, distinct = pd.factorize(np.fromiter(map(hash, words), np.int64, len(words)))
        first = np.zeros(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(words))[::-1]
        names = np.array([*words, ""], object)[:-1]
        sums = np.fromiter((zlib.crc32(words[i].encode()) for i in first.tolist()), np.int64, len(first))
        at = np.searchsorted(self.known, distinct)
        old = np.zeros(len(distinct), bool)
        inside = at < len(self.known)
        old[inside] = self.known[at[inside]] == distinct[inside]
        if (names != names[first[code]]).any() or (sums[old] != self.sums[at[old]]).any():
            return self.afresh(names)  # two words of one hash
        self.again[at[old]] = True
        new = np.flatnonzero(~old)
        if len(new):
            new = new[np.argsort(distinct[new])]
            got = self.contract([words[i].encode() for i in first[new].tolist()])
            place = np.searchsorted(self.known, distinct[new])
            self.rows = np.insert(self.rows, place, np.arange(len(new)) + len(self.ends) - 1)
            self.known, self.sums, self.again = np.insert(self.known, place, distinct[new]), np.insert(self.sums, place, sums[new]), np.insert(self.again, place, False)
            self.flat = np.concatenate([self.flat, *got])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(g) for g in got])])
            at = np.searchsorted(self.known, distinct)
        row = self.rows[at][code] if len(code) else np.empty(0, np.int64)
        return self.gathered(self.flat, self.ends, row)

    def afresh(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code, distinct = pd.factorize(names)
        got = self.contract([w.encode() for w in distinct])
        return self.gathered(np.concatenate(got), np.concatenate([[0], np.cumsum([len(g) for g in got])]), code)

    @staticmethod
    def gathered(flat: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = ends[row + 1] - ends[row]
        to = np.concatenate([[0], np.cumsum(lengths)])
        return flat[np.repeat(ends[row] - to[:-1], lengths) + np.arange(to[-1])], to

    def decode(self, ids: pa.Array) -> list[bytes]:
        """The bytes of each list of ids; a null list is empty."""
        lengths = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        out: list[bytes] = [b""] * len(ids)
        part = np.cumsum(lengths) // DECODED_AT_ONCE
        for rows in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(part)) + 1):
            if len(rows):
                self.db.register("docs", pa.table({"d": rows.astype(np.int64), "t": ids.slice(int(rows[0]), len(rows))}))
                got = self.db.sql(_DECODE).to_arrow_table()
                for d, b in zip(got["d"].to_pylist(), got["b"].to_pylist(), strict=True):
                    out[d] = b
        return out


@cache
def tokenizer(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(path, pattern)


def _encoded(own: Tokenizer, texts: pa.Array, most_chars: int) -> Iterator[pa.Array]:
    """The ids of the texts, some texts at a time."""
    some, chars = [], 0
    for low in range(0, len(texts), 256):
        for t in texts.slice(low, 256).to_pylist():
            some.append(t)
            chars += len(t or "")
            if chars > most_chars:
                yield own.encode(some)
                some, chars = [], 0
    yield own.encode(some)


def encode(text: Column, path: str = RANKS, pattern: str = PATTERN, most_chars: int = 1 << 20) -> Column:
    """The ids of a text (array<int>) by the rank file ``path``, which each executor reads at that place.

    A null or empty text has no ids. Every match of ``pattern`` is encoded by itself; no special tokens.
    Repeated rows get equal ids, an empty table stays empty, and no other column is touched.
    """
    bound_batches(SparkSession.active())

    @F.arrow_udf(ArrayType(IntegerType()))
    def run(texts: pa.Array) -> pa.Array:
        got = pa.concat_arrays(list(_encoded(tokenizer(path, pattern), texts, most_chars)))
        T.release()
        return got

    return run(text)


def decode(ids: Column, path: str = RANKS, pattern: str = PATTERN) -> Column:
    """The bytes of a list of ids; null and empty lists give no bytes, repeated rows equal ones; an empty table stays empty."""
    bound_batches(SparkSession.active())

    @F.arrow_udf(BinaryType())
    def run(lists: pa.Array) -> pa.Array:
        return pa.array(tokenizer(path, pattern).decode(lists), pa.binary())

    return run(ids)


def round_trip(text: Column, path: str = RANKS, pattern: str = PATTERN, most_chars: int = 1 << 20) -> Column:
    """A struct (ids, decoded) of ``encode`` and ``decode`` of its ids, in one go: a text is split and encoded once."""
    bound_batches(SparkSession.active())

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def run(texts: pa.Array) -> pa.Array:
        own = tokenizer(path, pattern)
        parts = []
        for ids in _encoded(own, texts, most_chars):
            parts.append(pa.StructArray.from_arrays([ids, pa.array(own.decode(ids), pa.binary())], ["ids", "decoded"]))
        got = pa.concat_arrays(parts)
        del parts
        T.release()
        return got

    return run(text)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", round_trip(F.col("text")).alias("z"))
    return docs.select(
        "doc_id",
        F.size("z.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("z.ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("z.decoded"), 256).alias("decoded_sha256"),
    )
