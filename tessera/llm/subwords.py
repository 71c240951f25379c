"""A text classifier by supervised subword embeddings.

A text is the mean of learned vectors: one for each of its words, for each pair of words that follow
one another and for each character n-gram of ``<word>``, all hashed into the same table; one for a
word that repeats the word before it, whichever it is; and one that every text has. A linear layer
and softmax give the classes. All is learned together by stochastic gradient descent in numpy, a text
a step.

Training takes a bounded sample of labelled rows to the driver. Prediction reads whole texts: since
the mean and the layer are linear, each hashed entry of the table is worth a fixed number for each
class, and these numbers are what tasks get. A word that recurs in a batch is looked up once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import text as T
from tessera.llm.common import bound_batches, fold, random_bits, table

BUCKETS, DIMENSION = 1 << 18, 16
#: Lengths of character n-grams.
SHORTEST, LONGEST = 3, 5
#: The bounds of the sample: rows of each class, bytes of a text (longer ones are scored, but not learned from), and of all texts.
PER_CLASS, MOST_BYTES, SAMPLE_BYTES = 1000, 1 << 15, 12 << 20
EPOCHS, RATE, SEED = 5, 1.0, 11
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.uint64(0x5851F42D4C957F2D)


def _cut(data: np.ndarray, at: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Pieces of texts (bytes, where each text begins, the first one's number); a long text comes in several, cut at white space."""
    for low, high in T.pieces(at, most):
        part, own = data[at[low] : at[high]], at[low : high + 1] - at[low]
        if len(part) <= 2 * most:
            yield part, own, low
            continue
        space, begin = np.flatnonzero(T.IS_SPACE[part]), 0
        while begin < len(part):
            after = np.searchsorted(space, begin + most)
            end = int(space[after]) if after < len(space) else len(part)
            yield part[begin:end], np.array([0, end - begin]), low
            begin = end if end > begin else end + 1


def entries(words: T.Words, buckets: int = BUCKETS, shortest: int = SHORTEST, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """(places in the table, the word of each) of all words: the words themselves and the n-grams of their characters between < and >."""
    n = len(words.starts)
    whole = (T.mix(words.hashes() + _SALT) & np.uint64(buckets - 1)).astype(np.int64)
    lengths = words.ends - words.starts
    # the words between < and >, one after the other, as code points
    to = np.cumsum(lengths + 2)
    marked = np.empty(int(to[-1]) if n else 0, np.uint8)
    inside = np.ones(len(marked), bool)
    inside[to - 1] = inside[to - lengths - 2] = False
    marked[to - lengths - 2], marked[to - 1] = ord("<"), ord(">")
    marked[inside] = words.data[np.repeat(words.starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]
    leads = (marked & 0xC0) != 0x80
    codes = np.frombuffer(marked.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(n), np.diff(np.concatenate([[0], np.cumsum(leads)[to - 1]])) if n else 0)
    places, of = [whole], [np.arange(n)]
    gram = codes.copy()
    for k in range(2, longest + 1):
        gram = gram[:-1] * _STEP + codes[k - 1 :] if len(gram) else gram
        if k >= shortest and len(gram):
            same = owner[: len(gram)] == owner[k - 1 :]
            places.append((T.mix(gram[same] + np.uint64(k)) & np.uint64(buckets - 1)).astype(np.int64))
            of.append(owner[: len(gram)][same])
    return np.concatenate(places), np.concatenate(of)


def pairs(hashes: np.ndarray, owner: np.ndarray, buckets: int, before: np.uint64 | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, text) of all words and the ones before them in their text; a word that repeats the one before has the place ``buckets``.

    ``before``: the hash of the word before the first one, if its text began earlier.
    """
    if before is not None:
        hashes, owner = np.concatenate([[before], hashes]), np.concatenate([owner[:1], owner])
    same = owner[1:] == owner[:-1]
    first, second = hashes[:-1][same], hashes[1:][same]
    place = (T.mix(first * _STEP + second) & np.uint64(buckets - 1)).astype(np.int64)
    return np.where(first == second, buckets, place), owner[1:][same]


@dataclass
class Model:
    """Learned vectors of the table, of a repeated word and of what every text has (the last rows), and the output layer; classes in their order."""

    classes: list
    vectors: np.ndarray
    output: np.ndarray

    def worth(self) -> np.ndarray:
        """What each entry of the table adds to each class before the mean."""
        return self.vectors @ self.output


def bags(texts: list[str | None], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct places, how often each) of each text; the last place is in every text once."""
    out = []
    for t in texts:
        words = T.split_words(*T.raw(pa.array([t], pa.string())))
        parts = [entries(words, buckets)[0], pairs(words.hashes(), T.owners(words.word_at), buckets)[0], [buckets + 1]]
        place, n = np.unique(np.concatenate(parts).astype(np.int64), return_counts=True)
        out.append((place.astype(np.int32), n.astype(np.float32)))
    return out


def fit(texts: list[str | None], labels: list, weights: dict | None = None, buckets: int = BUCKETS, dimension: int = DIMENSION, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Stochastic gradient descent on the weighted log loss, a text a step, with a rate that falls to 0.

    ``weights`` are the classes' (1 where it is None): a sample of equal parts learns the shares of
    the whole by them.
    """
    classes = sorted(set(labels))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dimension, 1 / dimension, (buckets + 2, dimension)).astype(np.float32)
    output = np.zeros((dimension, len(classes)), np.float32)
    target = np.searchsorted(classes, labels)
    weight = np.array([(weights or {}).get(c, 1.0) for c in classes])
    held, step, steps = bags(texts, buckets), 0, epochs * len(texts)
    for _ in range(epochs):
        for k in rng.permutation(len(held)).tolist():
            place, n = held[k]
            share = n / n.sum()
            hidden = share @ vectors[place]
            odds = hidden @ output
            odds = np.exp(odds - odds.max())
            error = odds / odds.sum()
            error[target[k]] -= 1
            error *= weight[target[k]] * rate * (1 - step / steps)
            back = output @ error
            output -= np.outer(hidden, error).astype(np.float32)
            vectors[place] -= share[:, None] * back[None].astype(np.float32)
            step += 1
    return Model(classes, vectors, output)


def odds_of(worth: np.ndarray, texts: pa.Array, most: int = 1 << 20) -> np.ndarray:
    """The sum of the worth of all entries of each text over their number, a column for each class."""
    buckets = len(worth) - 2
    data, at = T.raw(texts)
    sums, counts = np.repeat(worth[-1:].astype(np.float64), len(texts), axis=0), np.ones(len(texts))
    before, last = None, -1
    for part, own, low in _cut(data, at, most):
        words, n = T.split_words(part, own), len(own) - 1
        before, last = (before if low == last else None), low + n - 1
        if not len(words.starts):
            continue
        hashes, owner, rows = words.hashes(), T.owners(words.word_at), low + np.arange(n)
        code, distinct = pd.factorize(hashes)
        first = np.full(len(distinct), len(code))
        np.minimum.at(first, code, np.arange(len(code)))
        once = T.Words(part, np.array([0, len(part)]), words.starts[first], words.ends[first], np.array([0, len(first)]))
        place, of = entries(once, buckets)
        pair, pair_of = pairs(hashes, owner, buckets, before)
        before = hashes[-1] if n == 1 else None
        counts[rows] += np.bincount(owner, np.bincount(of, minlength=len(first)).astype(np.float64)[code], minlength=n) + np.bincount(pair_of, minlength=n)
        for c in range(worth.shape[1]):
            each = np.bincount(of, worth[place, c], minlength=len(first))
            sums[rows, c] += np.bincount(owner, each[code], minlength=n) + np.bincount(pair_of, worth[pair, c], minlength=n)
    return sums / counts[:, None]


def learn(labelled: DataFrame, docs: DataFrame, key: str, label: str, text: str = "text", per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES, sample_bytes: int = SAMPLE_BYTES, most_classes: int = 64) -> Model | None:
    """A model of the sample of ``labelled`` (key, label) whose texts are in ``docs``; None without any.

    The sample has at most ``per_class`` rows of a class, the first by a hash of the key, whose texts
    are no longer than ``most_bytes``, and of these, in random order, ``sample_bytes`` altogether; more
    than ``most_classes`` classes are an error. So what comes to the driver is bounded. Null keys, labels and texts are not learned from;
    a key with several labels or texts is learned with each.
    """
    spark = docs.sparkSession
    usable = labelled.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("sub_key"), F.col(label).alias("sub_label")).distinct()
    shares = {r["sub_label"]: r["n"] for r in usable.groupBy("sub_label").agg(F.count(F.lit(1)).alias("n")).limit(most_classes + 1).collect()}
    if len(shares) > most_classes:
        raise ValueError(f"more than {most_classes} classes")
    drawn = [r for c in shares for r in usable.where(F.col("sub_label") == F.lit(c)).orderBy(random_bits("subwords", F.col("sub_key")), "sub_key").limit(per_class).collect()]
    if not drawn:
        return None
    chosen = F.broadcast(spark.createDataFrame(drawn, usable.schema))
    found = docs.where(F.col(text).isNotNull() & (F.octet_length(text) <= most_bytes)).select(F.col(key).alias("sub_of"), F.col(text).alias("sub_text"))
    rows = found.join(chosen, F.col("sub_of") == F.col("sub_key")).select("sub_key", "sub_label", "sub_text").distinct().orderBy(random_bits("order", F.col("sub_key")), "sub_key", "sub_text")
    rows = rows.limit(per_class * len(shares)).collect()
    ends = np.cumsum([len(r["sub_text"].encode()) for r in rows])
    rows = rows[: max(1, int(np.searchsorted(ends, sample_bytes, "right")))]
    if not rows:
        return None
    labels = [r["sub_label"] for r in rows]
    total = sum(shares.values())
    weights = {c: len(labels) * n / total / max(1, labels.count(c)) for c, n in shares.items()}
    return fit([r["sub_text"] for r in rows], labels, weights)


def classify(docs: DataFrame, model: Model | None, text: str = "text", column: str = "class_scores") -> DataFrame:
    """``docs`` with the shares of the model's classes, in their order, as an array of doubles.

    A null text counts as empty and gets the scores of an empty text; without a model the array is
    empty. Equal texts get equal scores; an empty table stays empty; a column of that name is replaced.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    if model is None:
        return docs.withColumn(column, F.array().cast("array<double>"))
    shipped = spark.sparkContext.broadcast(model.worth())

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        odds = odds_of(shipped.value, texts)
        odds = np.exp(odds - odds.max(1, keepdims=True)) if len(odds) else odds
        shares = odds / odds.sum(1, keepdims=True)
        T.release()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(shares) + 1, dtype=np.int32) * shares.shape[1]), pa.array(shares.ravel()))

    return docs.withColumn(column, run(F.col(text)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, 5) == 0, F.lit(False))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", "quality")
    model = learn(labels, docs, "doc_id", "quality")
    scored = classify(docs, model)
    # without labels nothing speaks for either; with one kind of them the score is that kind's
    at = model.classes.index(1) if model and 1 in model.classes else None
    score = F.col("class_scores")[at] if at is not None else F.lit(0.5 if model is None else 0.0)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))
