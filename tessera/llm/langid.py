"""Language identification by interpolated Kneser-Ney character models.

One model of four-letter sequences for each language, all in the same sorted arrays of packed
sequences: four characters of 16 bits make one 64-bit key, and a row of the array holds the log
probability in every language. A text goes to the language of the lowest cross-entropy per
character. Rejection is calibrated on documents that the counts did not see.

The models are fitted on a bounded sample of labelled documents (``per_language`` for each of at
most ``most_languages``), chosen by a hash of the id, so they stay small enough to broadcast.
Prediction reads whole texts and nothing but texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from tessera.llm import text as T
from tessera.llm.common import bound_batches, fold, fraction, random_bits, table

ORDER = 4
SPACE = 32
UNDECIDED = "und"
#: The bounds of the sample: documents for each language, for counts and for calibration, and languages.
PER_LANGUAGE, PER_CALIBRATION, MOST_LANGUAGES = 1200, 300, 256
#: A language of fewer documents fits on all of them.
LEAST_SPLIT = 100
#: A text is rejected if its cross-entropy exceeds what this share of calibration documents has, by a tenth.
CALIBRATED = 0.995


@cache
def _folded() -> np.ndarray:
    """The 16-bit code of every code point: its lower-case letter, or a space for what is no letter."""
    codes = np.full(0x110000, SPACE, np.uint16)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            p = ord(low) if len(low) == 1 else c
            codes[c] = p if p < 0x10000 else 0xE000 + p % 0x1900  # planes above the first share private codes
    return codes


def sequences(texts: pa.Array, most_bytes: int = 1 << 20):
    """For each piece of the batch: (codes with three spaces before each text, where texts begin, letters in each)."""
    data, at = T.raw(texts)
    for low, high in T.pieces(at, most_bytes):
        part, own = data[at[low] : at[high]], at[low : high + 1] - at[low]
        leads = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        code = _folded()[np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
        begin = leads[own]
        letter = code != SPACE
        letters = T.per_text(letter, begin)
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # a space counts where it follows a letter of the same text
        first = begin[:-1][np.diff(begin) > 0]
        keep[first] = letter[first]
        kept = np.concatenate([[0], np.cumsum(keep)])[begin]
        padded = np.full(kept[-1] + 3 * (len(own) - 1), SPACE, np.uint16)
        place = np.arange(kept[-1]) + 3 * (np.repeat(np.arange(len(own) - 1), np.diff(kept)) + 1)
        padded[place] = code[keep]
        yield padded, kept, letters


def keys(padded: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The packed four characters that end at each character of the texts."""
    wide = padded.astype(np.uint64)
    packed = wide.copy()
    for j in range(1, ORDER):
        packed[j:] |= wide[:-j] << np.uint64(16 * j)
    return packed[np.arange(kept[-1]) + 3 * (np.repeat(np.arange(len(kept) - 1), np.diff(kept)) + 1)]


@dataclass
class Model:
    """Sorted keys of each order, with log probabilities and back-off weights by language (a column each)."""

    langs: list[str]
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: np.ndarray
    temperature: float = 0.1
    limit: np.ndarray | None = None

    def score(self, packed: np.ndarray) -> np.ndarray:
        """Log probabilities of the last of the packed characters after the others, a column for each language."""
        out = np.zeros((len(packed), len(self.langs)), np.float32)
        left = np.arange(len(packed))
        for n in range(ORDER, 0, -1):
            own = packed[left] & np.uint64((1 << 16 * n) - 1)
            at, found = _find(self.grams[n], own)
            out[left[found]] += self.logp[n][at[found]]
            left, own = left[~found], own[~found]
            if not len(left):
                return out
            if n > 1:
                at, found = _find(self.contexts[n], own >> np.uint64(16))
                out[left[found]] += self.backoff[n][at[found]]
        out[left] += self.floor
        return out


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, wanted)
    at[at == len(table)] = 0
    return at, (table[at] == wanted) if len(table) else np.zeros(len(wanted), bool)


def fit(counts: pd.DataFrame) -> Model:
    """Interpolated Kneser-Ney from (lang, gram, n) of the highest order; lower orders count distinct predecessors."""
    langs = sorted(counts["lang"].unique())
    gram = counts["gram"].to_numpy().view(np.uint64)
    lang = np.searchsorted(langs, counts["lang"])
    n = counts["n"].to_numpy(np.float64)
    grams: list = [None] * (ORDER + 1)
    seen: list = [None] * (ORDER + 1)
    grams[ORDER] = np.unique(gram)
    seen[ORDER] = np.zeros((len(grams[ORDER]), len(langs)))
    np.add.at(seen[ORDER], (np.searchsorted(grams[ORDER], gram), lang), n)
    for k in range(ORDER - 1, 0, -1):
        shorter = grams[k + 1] & np.uint64((1 << 16 * k) - 1)
        grams[k], at = np.unique(shorter, return_inverse=True)
        seen[k] = np.zeros((len(grams[k]), len(langs)))
        np.add.at(seen[k], at, (seen[k + 1] > 0).astype(float))
    uniform = 1.0 / (len(grams[1]) + 1)
    below = np.full((len(grams[1]), len(langs)), uniform)
    logp, contexts, backoff = [None] * (ORDER + 1), [None] * (ORDER + 1), [None] * (ORDER + 1)
    floor = None
    for k in range(1, ORDER + 1):
        c = seen[k]
        once, twice = (c == 1).sum(0), (c == 2).sum(0)
        discount = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5)
        contexts[k], at = np.unique(grams[k] >> np.uint64(16), return_inverse=True)
        total, kinds = np.zeros((len(contexts[k]), len(langs))), np.zeros((len(contexts[k]), len(langs)))
        np.add.at(total, at, c)
        np.add.at(kinds, at, (c > 0).astype(float))
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        if k > 1:
            lower = np.searchsorted(grams[k - 1], grams[k] & np.uint64((1 << 16 * (k - 1)) - 1))
            below = np.exp(logp[k - 1][lower])
        else:
            floor = np.log(weight[0] * uniform)
        p = np.where(total[at] > 0, np.maximum(c - discount, 0) / np.maximum(total[at], 1), 0) + weight[at] * below
        logp[k], backoff[k] = np.log(p), np.log(np.maximum(weight, 1e-12))
    as32 = lambda xs: [x if x is None else x.astype(np.float32) for x in xs]
    return Model(langs, grams, as32(logp), contexts, as32(backoff), floor.astype(np.float32))


def entropies(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(cross-entropy per character in nats by language, number of letters) of each text."""
    means, letters = [], []
    for padded, kept, own in sequences(texts):
        scores = model.score(keys(padded, kept))
        some = np.flatnonzero(np.diff(kept) > 0)
        mean = np.zeros((len(kept) - 1, len(model.langs)))
        if len(some):
            mean[some] = -np.add.reduceat(scores, kept[some], axis=0, dtype=np.float64) / np.diff(kept)[some, None]
        means.append(mean)
        letters.append(own)
    return np.concatenate([np.zeros((0, len(model.langs))), *means]), np.concatenate([np.zeros(0, np.int64), *letters])


def sharpness(mean: np.ndarray, temperature: float) -> np.ndarray:
    odds = np.exp((mean.min(1, keepdims=True) - mean) / temperature)
    return odds / odds.sum(1, keepdims=True)


def learn(labelled: DataFrame, text: str, lang: str, key: str, per_language: int, per_calibration: int, most_languages: int) -> Model | None:
    """Fits and calibrates on a sample of ``labelled``; None without any labelled text that has a letter.

    A language of fewer than ``LEAST_SPLIT`` documents fits on all of them, so that none is lost; nothing
    is left to calibrate it, and no text is rejected as too unlike it. Rows without a key are drawn by
    their text.
    """
    totals = labelled.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "lang").limit(most_languages).collect()
    if not totals:
        return None
    shares = labelled.sparkSession.createDataFrame([(r["lang"], 1.0 if r["rows"] < LEAST_SPLIT else min(0.8, per_language / r["rows"]), (per_language + per_calibration) / r["rows"]) for r in totals], "sample_lang string, fit_share double, all_share double")
    own_key = F.coalesce(F.col(key).cast("string"), F.xxhash64(F.col(text)).cast("string"))
    drawn = (
        labelled.withColumn("sample_at", fraction(random_bits("langid", own_key)))
        .join(F.broadcast(shares), F.col(lang) == F.col("sample_lang"))
        .where(F.col("sample_at") < F.least(F.col("all_share"), F.lit(1.0)))
        # with few documents, a fifth of them calibrates
        .withColumn("fits", F.col("sample_at") < F.col("fit_share"))
        .select(F.col("sample_lang").alias("lang"), F.col(text).alias("text"), "fits")
    )

    def count(batches):
        for batch in batches:
            owners = np.array(batch.column("lang").to_pylist(), object)
            low = 0
            for padded, kept, _ in sequences(batch.column("text")):
                packed, of = keys(padded, kept), owners[low : low + len(kept) - 1]
                low += len(kept) - 1
                spread = np.repeat(of, np.diff(kept))
                for name in set(of):
                    gram, n = np.unique(packed[spread == name], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": [name] * len(gram), "gram": pa.array(gram.view(np.int64)), "n": pa.array(n)})

    schema = StructType([StructField("lang", StringType()), StructField("gram", LongType()), StructField("n", LongType())])
    counts = drawn.where("fits").select("lang", "text").mapInArrow(count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if counts.empty:
        return None
    model = fit(counts)
    shipped = labelled.sparkSession.sparkContext.broadcast(model)
    held = drawn.where(~F.col("fits")).select("lang", _entropies(shipped).asNondeterministic()(F.col("text")).alias("mean")).where(F.col("mean").isNotNull()).toPandas()
    model.limit = np.full(len(model.langs), np.inf)
    held = held[held["lang"].isin(model.langs)]
    if len(held):
        mean, of = np.stack(held["mean"].to_list()), np.searchsorted(model.langs, held["lang"])
        tried = [0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5]
        model.temperature = min(tried, key=lambda t: -np.log(np.maximum(sharpness(mean, t)[np.arange(len(of)), of], 1e-12)).sum())
        for k in set(of):
            model.limit[k] = 1.1 * np.quantile(mean[of == k, k], CALIBRATED)
    return model


def _entropies(shipped: Broadcast):
    @F.arrow_udf(ArrayType(DoubleType()))
    def run(texts: pa.Array) -> pa.Array:
        mean, letters = entropies(shipped.value, texts)
        return pa.array([m if n else None for m, n in zip(mean.tolist(), letters.tolist(), strict=True)], pa.list_(pa.float64()))

    return run


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected``.

    lang_pred is the learned language of the lowest cross-entropy, the first by name in a tie, and
    ``und`` (score 0, no cross-entropy, rejected) for a null text, one without any letter, or without
    a model. score is the calibrated share of that language. rejected says that the text is less
    like the language than nearly all calibration documents. Equal texts get equal results; an empty
    table gives an empty table. Other columns stay, but for those named as a result.
    """
    docs = docs.drop("lang_pred", "score", "cross_entropy", "rejected", "langid_mean")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNDECIDED), "score": F.lit(0.0), "cross_entropy": F.lit(None).cast("double"), "rejected": F.lit(True)})
    spark = docs.sparkSession
    bound_batches(spark)
    mean = F.col("langid_mean")
    best = F.array_min(mean)
    at = F.array_position(mean, best).cast("int")
    odds = F.aggregate(mean, F.lit(0.0), lambda a, x: a + F.exp((best - x) / model.temperature))
    names, limits = F.array(*[F.lit(x) for x in model.langs]), F.array(*[F.lit(float(x)) for x in model.limit])
    return docs.withColumn("langid_mean", _entropies(spark.sparkContext.broadcast(model))(F.col(text))).select(
        "*",
        F.when(mean.isNull(), UNDECIDED).otherwise(F.element_at(names, at)).alias("lang_pred"),
        F.when(mean.isNull(), 0.0).otherwise(1 / odds).alias("score"),
        best.alias("cross_entropy"),
        F.when(mean.isNull(), True).otherwise(best > F.element_at(limits, at)).alias("rejected"),
    ).drop("langid_mean")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, 4) == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    model = learn(labelled, "text", "lang", "doc_id", PER_LANGUAGE, PER_CALIBRATION, MOST_LANGUAGES)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
