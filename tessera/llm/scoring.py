"""Language-model scoring by deleted interpolation.

The maximum-likelihood estimates of trigrams, bigrams, words (any ``order``) and of a uniform
distribution are mixed, with weights that hang on how often the context was seen: a bucket for each
power of two of the longest context that was seen at all. The weights are learned by
expectation-maximisation on held-out counts: each training token is estimated from the counts
without itself. What that needs of the corpus is one histogram of estimates, whose size is bounded by
the logarithms of counts; all counts are of the whole training part.

Counts never gather anywhere: blocks of documents ask for the counts of their distinct n-grams
(see ``blocks``), and the replies are used twice, for the histogram and for the scores. Words are told
apart by 63 bits of a hash, longer n-grams by 12 more than there are n-grams: one in some ten thousand counts
another's occurrences as its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import blocks as B
from tessera.llm import text as T
from tessera.llm.common import fold, forget_shuffles, materialize, settle, table

#: Words of the longest n-grams.
ORDER = 3
#: The end is a token; its hash is that of no word. A text's first context is its begin, at any length.
END, BEGIN = np.uint64(0x5EED_0000_0000_0E0C), np.uint64(0x5EED_0000_0000_0B16)
#: The lowest bit of a hash says that it is of two words or more; bits to spare for these.
LONG, SPARE = np.uint64(1), 12
#: Steps of a histogram's estimates in each doubling, and buckets of context counts of each length.
STEPS, BUCKETS, ROUNDS = 2, 48, 60
#: Step of an estimate of zero, and the offset and width of steps where a row is one number.
NEVER, OFFSET, WIDTH = -(1 << 20), 256, 10
TOKENS, WORDS = -1, -2
LEAST_WEIGHT = 1e-6


def trains(ids: np.ndarray) -> np.ndarray:
    """Whether a document is learned from: crc32 of its id's decimal text modulo 7 is not 2 (a null id is)."""
    return np.array([i == B.NULL_ID or zlib.crc32(str(i).encode()) % 7 != 2 for i in ids.tolist()], bool)


class Grams:
    """The tokens of a block: words and ends, the n-grams that end at each, and their distinct hashes with training counts."""

    def __init__(self, ids: np.ndarray, words: T.Words, order: int, leading: np.uint64) -> None:
        texts = len(ids)
        self.at = words.word_at + np.arange(texts + 1)
        n, first = int(self.at[-1]), self.at[:-1]
        token = np.full(n, END, np.uint64)
        token[np.arange(len(words.starts)) + T.owners(words.word_at)] = words.hashes(lower=True) & ~LONG
        train = trains(ids)
        self.train = np.repeat(train, np.diff(self.at))
        grams = [token]
        for m in range(1, order):
            context = np.empty(n, np.uint64)
            context[1:] = grams[-1][:-1]
            context[first] = BEGIN
            grams.append(T.mix(context * np.uint64(3) + token + np.uint64(m)))
        asked = [token, *(g & leading | LONG for g in grams[1:]), np.array([BEGIN])]
        self.hashes, which = np.unique(np.concatenate(asked), return_inverse=True)
        #: Of each token the entry of its n-gram of every length, from one word on, and of their contexts, from one word on.
        self.grams = [which[m * n : (m + 1) * n] for m in range(order)]
        self.contexts = []
        for gram in self.grams[:-1]:
            context = np.empty(n, np.int64)
            context[1:] = gram[:-1]
            context[first] = which[order * n]
            self.contexts.append(context)
        # the begin counts once for each training document
        self.counts = np.bincount(np.concatenate([g[self.train] for g in self.grams]), minlength=len(self.hashes))
        self.counts[which[order * n]] = train.sum()

    def estimates(self, total: np.ndarray, some: np.ndarray | slice, own: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(bucket, estimates of n-grams from the longest to two words, word count) of ``some`` tokens, without ``own`` occurrences."""
        words = total[self.grams[0][some]] - own
        bucket = np.zeros(len(words), np.int64)
        ratios = []
        for m, (gram, context) in enumerate(zip(self.grams[1:], self.contexts, strict=True)):
            seen = total[context[some]] - own
            log = np.frexp(np.maximum(seen, 1).astype(float))[1]  # one more than the logarithm
            bucket = np.where(seen > 0, m * BUCKETS + np.minimum(log, BUCKETS), bucket)
            ratios.insert(0, (total[gram[some]] - own) / np.maximum(seen, 1))
        return bucket, ratios, words


def _answer(hashes: np.ndarray, numbers: list[np.ndarray]) -> list[np.ndarray]:
    """The training count of each hash; and 1 at one of the entries of each word that was seen in training."""
    begins = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    total = np.add.reduceat(numbers[0], begins)
    marks = np.zeros(len(hashes), np.int64)
    marks[begins] = (total > 0) & (hashes[begins] & LONG == 0) & (hashes[begins] != BEGIN)
    return [np.repeat(total, np.diff(np.append(begins, len(hashes)))), marks]


def _step(count: np.ndarray) -> np.ndarray:
    """The logarithm of a positive count or ratio in steps; far below all for 0."""
    return np.where(count > 0, np.round(np.log2(np.where(count > 0, count, 1)) * STEPS), NEVER).astype(np.int64)


def _packed(bucket: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """A row of a histogram as one number."""
    out = bucket
    for step in steps:
        out = (out << WIDTH) + np.where(step == NEVER, 0, step + OFFSET)
    return out


def _unpacked(numbers: np.ndarray, order: int) -> list[np.ndarray]:
    fields = [(numbers >> WIDTH * k) & ((1 << WIDTH) - 1) for k in range(order - 1, -1, -1)]
    return [numbers >> WIDTH * order, *(np.where(f == 0, NEVER, f - OFFSET) for f in fields)]


def learn_weights(histogram: np.ndarray, tokens: int, uniform: float) -> np.ndarray:
    """Weights (n-grams from the longest to one word, uniform) of each bucket from rows (bucket, steps from the longest to one word, n), by expectation-maximisation.

    A bucket that no token is in takes the weights of the next below of its contexts' length.
    """
    order = histogram.shape[1] - 2
    lowest = np.array([0.0] * (order - 1) + [0.9, 0.1])
    weights = np.tile(lowest, ((order - 1) * BUCKETS + 1, 1))
    value = lambda step: np.where(step > NEVER, np.exp2(step / STEPS), 0.0)
    histogram = histogram[np.argsort(histogram[:, 0], kind="stable")]
    cuts = np.searchsorted(histogram[:, 0], np.arange(len(weights) + 1))
    for k in range(len(weights)):
        own = histogram[cuts[k] : cuts[k + 1]]
        if not len(own):
            weights[k] = weights[k - 1] if k % BUCKETS != 1 and k else lowest
            continue
        p = np.stack([*(value(own[:, j]) for j in range(1, order)), value(own[:, order]) / max(tokens - 1, 1), np.full(len(own), uniform)], 1)
        n = own[:, -1:]
        w = np.append(np.full(order, 0.8 / order), 0.2)
        for _ in range(ROUNDS):
            share = p * w
            share /= share.sum(1, keepdims=True)
            w = (share * n).sum(0) / n.sum()
            w[-2:] = np.maximum(w[-2:], LEAST_WEIGHT)
            w /= w.sum()
        weights[k] = w
    return weights


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, block_bytes: int = B.BLOCK_BYTES, range_bytes: int = B.RANGE_BYTES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each document.

    Tokens are the words of the lower-cased (A-Z) text and one end. base_score sums
    log10((c + 1) / (N + V + 1)); score is the model's log10 probability of the whole text, by n-grams of
    up to ``order`` words (two or more). Null and empty texts have their end only. Repeated rows count as
    often as they occur; a null id is learned from. Without training documents only the uniform
    probability is left. An empty table gives an empty table.
    """
    return settle(docs.sparkSession, lambda: _scored(docs, key, text, order, block_bytes, range_bytes))


def _scored(docs: DataFrame, key: str, text: str, order: int, block_bytes: int, range_bytes: int) -> DataFrame:
    blocks = B.pack(docs, key, text, block_bytes)
    scale = B.scale_of(blocks, range_bytes)
    leading = scale.leading(SPARE)

    def ask(row: dict) -> tuple[np.ndarray, list[np.ndarray]]:
        g = Grams(*B.unpack(row), order, leading)
        return g.hashes, [g.counts]

    def tally(row: dict) -> Iterator[pa.RecordBatch]:
        """The block's part of the histogram, and (as TOKENS and WORDS) of N and V."""
        g = Grams(*B.unpack(row), order, leading)
        total, marks = B.replies_of(row, 2)
        bucket, ratios, words = g.estimates(total, g.train, 1)
        held, n = np.unique(_packed(bucket, [*map(_step, ratios), _step(words)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, [TOKENS, WORDS])), pa.array(np.append(n, [g.train.sum(), marks.sum()]))], ["held", "n"])

    # replies are written without texts, and what made them goes before the texts meet them
    answered = B.with_replies(blocks, materialize(B.replies(blocks, ask, _answer, scale.buckets)))
    forget_shuffles(docs.sparkSession)
    tallied = B.map_blocks(answered, tally, "held long, n long").groupBy("held").agg(F.sum("n").alias("n")).toArrow()  # bounded: logarithms of counts
    forget_shuffles(docs.sparkSession)
    held, n = (tallied.column(c).to_numpy() for c in ("held", "n"))
    tokens, kinds = (int(n[held == k].sum()) for k in (TOKENS, WORDS))
    uniform = 1.0 / (kinds + 1)
    weights = learn_weights(np.stack([*_unpacked(held[held >= 0], order), n[held >= 0]], 1), tokens, uniform)

    def score(row: dict) -> Iterator[pa.RecordBatch]:
        ids, words = B.unpack(row)
        g = Grams(ids, words, order, leading)
        bucket, ratios, word = g.estimates(B.replies_of(row, 2)[0], slice(None), 0)
        w = weights[bucket]
        p = sum(w[:, k] * r for k, r in enumerate(ratios)) + w[:, -2] * word / max(tokens, 1) + w[:, -1] * uniform
        base = np.log10((word + 1) / (tokens + kinds + 1))
        at = g.at[:-1]
        columns = [np.diff(g.at), np.add.reduceat((word > 0).astype(np.int64), at), np.full(len(ids), tokens), np.add.reduceat(base, at), np.add.reduceat(np.log10(p), at)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == B.NULL_ID), *map(pa.array, columns)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return B.map_blocks(answered, score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, 7) == 2, F.lit(False))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
