"""Substring deduplication by relative Lempel-Ziv factors.

Every document is parsed against all documents with smaller ids. A first question finds the windows
of 13 words that recur at all; a second one, for these alone, indexes where each stands: the smallest
document and the first position there. The parse then goes through a document's windows from the
left: a factor begins at a window that a smaller document holds and is extended, word by word, as
long as the next window stands at the next position of the same document. At each boundary the next
factor begins with that window's own place, if it has one. So a factor is a contiguous part of its
reference, of 13 words or more, and all words of factors are duplicates.

A window's place is its first one. A longest match among all its places isn't sought: a passage that
is everywhere has as many places as documents, and no task may gather them.

Windows are equal if two independent hashes of their words are, 64 and 32 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import blocks as B
from tessera.llm import text as T
from tessera.llm.common import settle, table

WINDOW = 13
#: Bits to spare in the first question, beyond those that tell the windows of a corpus of this size apart.
SPARE = 6
RESULT = "doc_id long, n_words long, n_removed long, kept_text string, factors array<struct<start:int,end:int,reference:long,at:int>>"


class Windows:
    """The windows of a block's texts: two hashes of each, the document and the word where it begins."""

    def __init__(self, ids: np.ndarray, words: T.Words, window: int) -> None:
        hashes = words.hashes()
        self.grams, self.at, self.begins = T.windows(hashes, words.word_at, window)
        self.check = T.windows(T.mix(hashes ^ T._STEP), words.word_at, window)[0] >> np.uint64(32)
        self.owner = T.owners(self.begins)
        self.doc = ids[self.owner]
        self.place = self.at - words.word_at[self.owner]  # in words from the text's begin


def _least(groups: list[np.ndarray], doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(an entry of each group of equal ``groups``, by rising groups, with the smallest (doc, place); which of them each entry belongs to; whether it has its doc)."""
    order = np.lexsort((place, doc, *groups[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([g[order[1:]] != g[order[:-1]] for g in groups])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    first = order[new]
    return first, of, doc == doc[first][of]


def _recurring(hashes: np.ndarray, numbers: list[np.ndarray]) -> list[np.ndarray]:
    """Whether the windows of more than one document share these bits."""
    begins = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return [np.repeat((np.add.reduceat(numbers[0], begins) > 1).astype(np.int64), np.diff(np.append(begins, len(hashes))))]


def _places(hashes: np.ndarray, numbers: list[np.ndarray]) -> list[np.ndarray]:
    """The smallest (doc, place) of each window, for those who asked with a greater doc."""
    check, doc, place = numbers
    first, of, own = _least([hashes, check], doc, place)
    return [~own, check, doc[first][of], place[first][of]]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, factors) of each document.

    kept_text is what is left, joined by spaces (``digest``: its SHA-256); factors are spans of words,
    end exclusive, each with the document that holds it and the word of that where it begins. Documents
    of equal id never remove from each other; a null id counts as greater than all others. Null, empty
    and short texts (fewer than ``window`` words) lose nothing. An empty table gives an empty table.
    """
    return settle(docs.sparkSession, lambda: _remove(docs, key, text, window, digest))


def _remove(docs: DataFrame, key: str, text: str, window: int, digest: bool) -> DataFrame:
    blocks = B.pack(docs, key, text)
    scale = B.scale_of(blocks)
    leading = scale.leading(SPARE)

    def ask_often(row: dict) -> tuple[np.ndarray, list[np.ndarray]]:
        w = Windows(*B.unpack(row), window)
        distinct, of = np.unique(w.grams & leading, return_inverse=True)
        least, most = np.full(len(distinct), B.NULL_ID), np.full(len(distinct), -B.NULL_ID)
        np.minimum.at(least, of, w.doc)
        np.maximum.at(most, of, w.doc)
        return distinct, [1 + (least < most)]

    def ask_where(row: dict) -> tuple[np.ndarray, list[np.ndarray]]:
        w = Windows(*B.unpack(row), window)
        some = np.flatnonzero(B.replies_of(row, 1)[0][np.unique(w.grams & leading, return_inverse=True)[1]]) if len(w.grams) else np.empty(0, np.int64)
        first = some[_least([w.grams[some], w.check[some]], w.doc[some], w.place[some])[0]]
        return w.grams[first], [w.check[first], w.doc[first], w.place[first]]

    def parse(row: dict) -> Iterator[pa.RecordBatch]:
        ids, words = B.unpack(row)
        w = Windows(ids, words, window)
        at, owner = w.at, w.owner
        # the place of each window: the block's own first one, or a smaller one elsewhere
        reference, place = w.doc.copy(), w.place.copy()
        first, of, _ = _least([w.grams, w.check], w.doc, w.place)
        hashes, (check, doc, there) = B.hits_of(row, 3)
        if len(first) and len(hashes):
            names = np.concatenate([w.grams[first], hashes]), np.concatenate([w.check[first], check.view(np.uint64)])
            best, which, _ = _least(list(names), np.concatenate([w.doc[first], doc]), np.concatenate([w.place[first], there]))
            of = which[: len(first)][of]
            reference, place = np.concatenate([w.doc[first], doc])[best][of], np.concatenate([w.place[first], there])[best][of]
        elif len(first):
            reference, place = w.doc[first][of], w.place[first][of]
        hit = reference < w.doc
        # a factor goes on while the next window of the text stands at the next place of the reference
        follows = np.zeros(len(hit), bool)
        follows[1:] = hit[1:] & hit[:-1] & (owner[1:] == owner[:-1]) & (reference[1:] == reference[:-1]) & (place[1:] == place[:-1] + 1)
        start = np.flatnonzero(hit & ~follows)
        end = np.flatnonzero(hit & ~np.append(follows[1:], False))
        change = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(change, at[start], 1)
        np.add.at(change, at[end] + window, -1)
        removed = np.cumsum(change)[:-1] > 0
        factor_at = np.searchsorted(owner[start], np.arange(len(ids) + 1)) if len(start) else np.zeros(len(ids) + 1, np.int64)
        data = words.data.tobytes()
        kept = []
        for k in range(len(ids)):
            a, b = words.word_at[k], words.word_at[k + 1]
            if removed[a:b].any():
                left = np.flatnonzero(~removed[a:b]) + a
                body = b" ".join([data[i:j] for i, j in zip(words.starts[left].tolist(), words.ends[left].tolist(), strict=True)])
            else:
                body = b" ".join(data[words.text_at[k] : words.text_at[k + 1]].split())
            kept.append(hashlib.sha256(body).hexdigest() if digest else body.decode())
        base = words.word_at[owner[start]] if len(start) else np.empty(0, np.int64)
        factors = pa.StructArray.from_arrays(
            [pa.array(at[start] - base, pa.int32()), pa.array(at[end] + window - base, pa.int32()), pa.array(reference[start], pa.int64()), pa.array(place[start], pa.int32())],
            ["start", "end", "reference", "at"],
        )
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64(), mask=ids == B.NULL_ID),
                pa.array(np.diff(words.word_at), pa.int64()),
                pa.array(T.per_text(removed, words.word_at), pa.int64()),
                pa.array(kept, pa.string()),
                pa.ListArray.from_arrays(pa.array(factor_at, pa.int32()), factors),
            ],
            ["doc_id", "n_words", "n_removed", "kept_text", "factors"],
        )

    often = B.ask_and_answer(blocks, ask_often, _recurring, scale.buckets)
    return B.map_blocks(B.with_replies(blocks, B.replies(often, ask_where, _places, scale.buckets, hits=True)), parse, RESULT)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept_text").alias("kept_sha256"), F.size("factors").cast("long").alias("n_factors"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)
), m AS (
  SELECT doc_id, i, place.d AS least, place.i AS spot FROM (SELECT doc_id, i, min({'d': doc_id, 'i': i}) OVER (PARTITION BY gram) AS place FROM g)
), h AS (
  SELECT doc_id, i, least, spot, lag({'i': i, 'd': least, 'p': spot}) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM m WHERE least < doc_id
), f AS (
  SELECT doc_id, count(*) FILTER (b IS NULL OR b.i <> i - 1 OR b.d <> least OR b.p <> spot - 1) AS n FROM h GROUP BY doc_id
), c AS (
  SELECT DISTINCT doc_id, i + j AS i FROM h, (SELECT unnest(range(13)) AS j)
), k AS (
  SELECT w.doc_id, len(w.words) AS n_words, u.i, u.word, c.i IS NOT NULL AS removed
  FROM w LEFT JOIN (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w) u ON w.doc_id = u.doc_id LEFT JOIN c ON u.doc_id = c.doc_id AND u.i = c.i
)
SELECT k.doc_id, any_value(n_words)::BIGINT AS n_words, (count(*) FILTER (removed AND word IS NOT NULL))::BIGINT AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY k.i) FILTER (NOT removed), '')) AS kept_sha256, coalesce(any_value(f.n), 0)::BIGINT AS n_factors
FROM k LEFT JOIN f ON k.doc_id = f.doc_id GROUP BY k.doc_id
"""
