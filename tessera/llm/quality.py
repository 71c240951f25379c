"""Quality rules with adaptive thresholds.

Fixed cutoffs suit no two languages or sources alike. Here the fences of each rule come from the
quantiles of the rule's measure in a document's own language and source. Quantiles are read from
log-linear histograms: a bucket keeps the leading seven bits of a value, so counts of two sketches
add up, no order of merging changes them, and a quantile is off by less than a sixty-fourth.
A group's quartiles are drawn towards those of its language, and these towards those of all
documents, by as much as ``PRIOR_ROWS`` documents would: few documents say little, and there is no
size at which a group's own quartiles set in. Documents then join the fences of their group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm import text as T
from tessera.llm.common import bound_batches, materialize, settle, small, table

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Rules: name -> (measure in thousandths, slack beyond the fence). A document is beyond a rule if its
#: measure is above third quartile + SPAN * (third - first quartile) + slack of its group.
RULES = {
    "symbols": ("n_symbols * 1000 div greatest(n_words, 1)", 100),
    "long_words": ("word_chars * 1000 div greatest(n_words, 1)", 2000),
    "upper": ("n_upper * 1000 div greatest(word_chars, 1)", 250),
    "dup_lines": ("n_dup_lines * 1000 div greatest(n_lines, 1)", 500),
    "repeats": ("n_repeat_words * 1000 div greatest(n_words, 1)", 300),
}
SPAN = 4
#: So many documents the quartiles of the wider group count for.
PRIOR_ROWS = 50


def _stats(w: T.Words) -> list[np.ndarray]:
    data, n = w.data, len(w.text_at) - 1
    words = np.diff(w.word_at)
    leads = (data & 0xC0) != 0x80
    chars = T.per_text(leads & ~T.IS_SPACE[data], w.text_at)
    symbols = T.per_text(SYMBOLS[data], w.text_at)
    upper = T.per_text((data >= 65) & (data <= 90), w.text_at)
    # lines: from a text's begin or behind a \n to the next \n or the text's end
    breaks = np.flatnonzero(data == 10)
    nonempty = np.flatnonzero(np.diff(w.text_at) > 0)
    line_from = np.sort(np.concatenate([w.text_at[nonempty], breaks + 1]), kind="stable")
    line_to = np.sort(np.concatenate([w.text_at[nonempty + 1], breaks]), kind="stable")
    has_word = np.searchsorted(w.starts, line_to) > np.searchsorted(w.starts, line_from)
    line_from, line_to = line_from[has_word], line_to[has_word]
    line_of = np.searchsorted(w.text_at, line_from, "right") - 1
    lines = np.bincount(line_of, minlength=n)
    line_hash = T.mix(T.hash_spans(data, line_from, line_to) + line_of.astype(np.uint64) * T._STEP)
    _, first = np.unique(line_hash, return_index=True)
    distinct = np.bincount(line_of[first], minlength=n)
    # words in windows of three that occur again in their text
    grams, at, gram_at = T.windows(w.hashes(), w.word_at, 3)
    own = T.mix(grams + T.owners(gram_at).astype(np.uint64) * T._STEP)
    order = np.argsort(own)
    same = own[order[1:]] == own[order[:-1]]
    twice = np.zeros(len(own), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(w.starts) + 2, bool)
    for j in range(3):
        covered[at[twice] + j] = True
    repeats = T.per_text(covered[: len(w.starts)], w.word_at)
    return [words, chars, symbols, lines - distinct, repeats, lines, upper]


@F.arrow_udf(StructType([StructField(x, LongType()) for x in STATS]))
def _text_stats(texts: pa.Array) -> pa.Array:
    parts = [_stats(w) for w in T.in_pieces(texts)]
    return pa.StructArray.from_arrays([pa.array(np.concatenate([p[k] for p in parts]) if parts else [], pa.int64()) for k in range(len(STATS))], list(STATS))


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``STATS`` for each whole text, in place of any of these names; a null text counts as empty."""
    bound_batches(docs.sparkSession)
    # not to be moved into a filter and then run again for the columns
    return docs.drop(*STATS).withColumn("quality_stats", _text_stats.asNondeterministic()(F.col(text))).select("*", "quality_stats.*").drop("quality_stats")


def bucket(value: Column) -> Column:
    """The lower edge of a value's bucket: its seven leading bits, then zeros."""
    unit = F.expr("1L") * F.pow(F.lit(2.0), F.greatest(F.length(F.bin(value)) - 7, F.lit(0))).cast("long")
    return F.floor(value / unit) * unit


def sketches(docs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., rule, edge, n): the histogram of every rule's measure in every group."""
    measures = F.array(*[F.struct(F.lit(rule).alias("rule"), F.expr(measure).alias("value")) for rule, (measure, _) in RULES.items()])
    long = docs.select(*by, F.explode(measures).alias("m")).select(*by, "m.rule", bucket(F.col("m.value")).alias("edge"))
    return long.groupBy(*by, "rule", "edge").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by..., rule, group_rows, q1, q3) from sketches, which are merged to the groups ``by``."""
    merged = sketch.groupBy(*by, "rule", "edge").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "rule")
    upto = group.orderBy("edge").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(group))
    quartile = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("all") * k, F.col("edge"))).cast("double")
    return ranked.groupBy(*by, "rule").agg(F.max("all").alias("group_rows"), quartile(1).alias("q1"), quartile(3).alias("q3"))


def group_fences(stats: DataFrame, lang: str = "lang", source: str = "source", prior_rows: int = PRIOR_ROWS, span: int = SPAN) -> DataFrame:
    """(quality_lang, quality_source, fence of each rule) for every language and source that occur together."""
    keyed = stats.select(F.col(lang).alias("quality_lang"), F.col(source).alias("quality_source"), *STATS)
    sketch = materialize(sketches(keyed, ["quality_lang", "quality_source"]))
    fine, by_lang, whole = (quartiles(sketch, by) for by in (["quality_lang", "quality_source"], ["quality_lang"], []))
    by_lang = by_lang.select(F.col("quality_lang").alias("l"), F.col("rule").alias("lr"), F.col("group_rows").alias("lang_rows"), F.col("q1").alias("l1"), F.col("q3").alias("l3"))
    whole = F.broadcast(whole.select(F.col("rule").alias("wr"), F.col("q1").alias("w1"), F.col("q3").alias("w3")))  # a row for each rule
    joined = fine.join(by_lang, F.col("quality_lang").eqNullSafe(F.col("l")) & (F.col("rule") == F.col("lr"))).join(whole, F.col("rule") == F.col("wr"))
    drawn = lambda rows, own, wider: (rows * own + prior_rows * wider) / (rows + prior_rows)
    one, three = (drawn(F.col("group_rows"), F.col(f"q{k}"), drawn(F.col("lang_rows"), F.col(f"l{k}"), F.col(f"w{k}"))) for k in (1, 3))
    slack = F.create_map(*[F.lit(x) for rule, (_, slack) in RULES.items() for x in (rule, slack)])[F.col("rule")]
    fenced = joined.withColumn("fence", three + span * (three - one) + slack)
    return fenced.groupBy("quality_lang", "quality_source").agg(*[F.max(F.when(F.col("rule") == rule, F.col("fence"))).alias(f"fence_{rule}") for rule in RULES])


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep_text: bool = True, most_broadcast: int = 20_000, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """``docs`` with the columns of ``STATS``, ``base_failed``, ``broken`` (the rules it breaks) and ``kept``.

    base_failed: fewer than 50 words, or more than half of them in repeated windows of three words.
    kept: neither base_failed nor beyond a fence of its language and source. Null languages and
    sources are groups of their own. Null and empty texts have no words, so they fail. An empty table
    gives an empty table. Repeated rows are judged alike. Other columns stay, but for those named as
    a result or ``quality_*`` or ``fence_*``.

    ``docs`` is read twice, once for the sketches and once for the verdicts; no document is written or
    moved. Groups above ``most_broadcast`` meet the documents by a shuffle.
    """
    docs = docs.drop("base_failed", "broken", "kept", *[c for c in docs.columns if c.lower().startswith(("quality_", "fence_"))])
    limits = settle(docs.sparkSession, lambda: group_fences(with_stats(docs, text), lang, source, prior_rows))
    stats = with_stats(docs, text)
    stats = stats if keep_text else stats.drop(text)
    broken = F.filter(F.array(*[F.when(F.expr(measure) > F.col(f"fence_{rule}"), F.lit(rule)) for rule, (measure, _) in RULES.items()]), lambda x: x.isNotNull())
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        stats.join(small(limits, most_broadcast), F.col(lang).eqNullSafe(F.col("quality_lang")) & F.col(source).eqNullSafe(F.col("quality_source")))
        .withColumn("base_failed", failed)
        .withColumn("broken", broken)
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
        .drop("quality_lang", "quality_source", *[f"fence_{rule}" for rule in RULES])
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(docs, keep_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("broken", ",").alias("broken"))


def _sql_fences(by: str) -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {keys}rule"
    return f"""SELECT {keys}rule, max(total) AS rows_in, min(edge) FILTER (upto * 4 >= total) AS q1, min(edge) FILTER (upto * 4 >= total * 3) AS q3
    FROM (SELECT {keys}rule, edge, sum(n) OVER ({part} ORDER BY edge) AS upto, sum(n) OVER ({part}) AS total
          FROM (SELECT {keys}rule, edge, sum(n) AS n FROM sketch GROUP BY {keys}rule, edge)) GROUP BY {keys}rule"""


_MEASURES = {rule: measure.replace(" div ", " // ") for rule, (measure, _) in RULES.items()}
ORACLE_SQL = rf"""
WITH base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines, row_number() OVER () AS rid FROM documents
), grams AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM base)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1
), repeats AS (
  SELECT rid, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid
), stats AS (
  SELECT doc_id, lang, source, len(words)::BIGINT AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, length(regexp_replace(body, '[^A-Z]', '', 'g'))::BIGINT AS n_upper
  FROM base b LEFT JOIN repeats r ON b.rid = r.rid
), measured AS (
  {" UNION ALL ".join(f"SELECT lang, source, '{rule}' AS rule, {m} AS value FROM stats" for rule, m in _MEASURES.items())}
), sketch AS (
  SELECT lang, source, rule, (value // u) * u AS edge, count(*) AS n FROM (SELECT *, (1::BIGINT << greatest(length(bin(value)) - 7, 0)::BIGINT) AS u FROM measured) GROUP BY ALL
), fine AS ({_sql_fences("lang, source")}), langs AS ({_sql_fences("lang")}), whole AS ({_sql_fences("")}
), slack AS (
  {" UNION ALL ".join(f"SELECT '{rule}' AS rule, {s} AS slack" for rule, (_, s) in RULES.items())}
), drawn AS (
  SELECT f.lang, f.source, f.rule, slack, {", ".join(f"(f.rows_in * f.q{k}::DOUBLE + {PRIOR_ROWS} * ((l.rows_in * l.q{k}::DOUBLE + {PRIOR_ROWS} * w.q{k}::DOUBLE) / (l.rows_in + {PRIOR_ROWS})::DOUBLE)) / (f.rows_in + {PRIOR_ROWS})::DOUBLE AS q{k}" for k in (1, 3))}
  FROM fine f JOIN langs l ON f.lang IS NOT DISTINCT FROM l.lang AND f.rule = l.rule JOIN whole w ON f.rule = w.rule JOIN slack s ON f.rule = s.rule
), fence AS (
  SELECT lang, source, rule, q3 + {SPAN} * (q3 - q1) + slack AS fence FROM drawn
), wide AS (
  SELECT lang, source, {", ".join(f"max(fence) FILTER (rule = '{rule}') AS fence_{rule}" for rule in RULES)} FROM fence GROUP BY lang, source
), judged AS (
  SELECT s.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    array_to_string([x FOR x IN [{", ".join(f"CASE WHEN {m} > fence_{rule} THEN '{rule}' END" for rule, m in _MEASURES.items())}] IF x IS NOT NULL], ',') AS broken
  FROM stats s JOIN wide w ON s.lang IS NOT DISTINCT FROM w.lang AND s.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(broken, '') = '' AS kept, coalesce(broken, '') AS broken FROM judged
"""
