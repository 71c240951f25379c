"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a token budget. As many complete epochs as fit come first; what is left of the
budget is filled with documents in the order of exponential keys ``-ln(u) / weight``, so that a
better document is more likely to be in the fractional epoch.

Only DataFrame functions are used. A source of any size is cut into ranges of its keys by a histogram
of the keys that it really has, whatever its weights: buckets of about a hundredth of a key's value,
within which keys lie evenly, are cut further by their counts. So no task sorts more than about
``rows_per_range`` rows; prefix sums of the sizes of buckets and ranges join them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import fraction, materialize, n_words, random_bits, small, table

#: Weights of the sources in their order, repeated as often as it takes.
WEIGHTS = (5, 2, 1)
#: A source is repeated at most so often.
MOST_EPOCHS = 3
SEED = 20260
#: Buckets of keys for each factor of e.
BUCKETS = 100
#: What marks junk in a text; the more of it, the less likely the document is in a fractional epoch.
JUNK = "#*$%&|<>{}[]~^0123456789"


def quality_weight(text: Column) -> Column:
    """1 for a text without junk characters, falling to 0.05 where they are a quarter of it or more."""
    junk = (F.length(text) - F.length(F.translate(text, JUNK, ""))).cast("double")
    share = junk / F.greatest(F.length(text), F.lit(1)).cast("double")
    return F.coalesce(F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * share), F.lit(0.05))


def _key(weight: str, draw: str) -> Column:
    return -F.log(F.col(draw)) / F.col(weight)


def _epochs() -> Column:
    """Complete epochs of a source."""
    return F.when(F.col("mix_source_size") > 0, F.floor(F.col("mix_target") / F.col("mix_source_size"))).otherwise(F.lit(0))


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """``totals`` (source, source_size, ...) with each source's ``target``.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes. A
    target ends at ``most_epochs`` times its source's size, and the excess is shared anew by weight
    until none is above: with the sources in the order of cap over weight, those before the first
    one that its share doesn't fill are at their caps, and the rest get what is left by weight.
    """
    whole = Window.partitionBy()
    by_name = whole.orderBy(F.col("source").asc_nulls_last())
    by_cap = whole.orderBy(F.col("cap") / F.col("source_weight"), F.col("position"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    shared = (
        totals.withColumn("position", F.row_number().over(by_name) - 1)
        .withColumn("source_weight", weight)
        .withColumn("cap", F.col("source_size") * most_epochs)
        .withColumn("all_size", F.sum("source_size").over(whole))
        .withColumn("rest", F.col("all_size") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("level", F.col("rest").cast("double") / F.sum("source_weight").over(after))
    )
    fits = F.when(F.col("level") * F.col("source_weight") <= F.col("cap"), F.col("level"))
    return (
        shared.withColumn("open", F.min(F.when(fits.isNotNull(), F.struct(F.col("cap") / F.col("source_weight"), F.col("position"), F.col("level").alias("level")))).over(whole))
        .withColumn("level", F.coalesce(F.col("open.level"), F.lit(0.0)))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("source_weight")))
        .drop("position", "source_weight", "cap", "all_size", "rest", "open", "level")
    )


def in_ranges(docs: DataFrame, source: str, size: str, weight: str, draw: str, weights: tuple[int, ...], most_epochs: int, rows_per_range: int, most_broadcast: int) -> DataFrame:
    """``docs`` with their source's size and target, and the range of keys that each is in: (mix_source, mix_bucket, mix_range)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower().startswith("mix_")])
    keyed = docs.withColumn("mix_key", _key(weight, draw)).withColumn("mix_source", F.col(source)).withColumn("mix_bucket", F.floor(F.log("mix_key") * BUCKETS))
    histogram = materialize(keyed.groupBy("mix_source", "mix_bucket").agg(F.count(F.lit(1)).alias("mix_rows"), F.sum(size).alias("mix_size")))
    totals = histogram.groupBy(F.col("mix_source").alias("source")).agg(F.sum("mix_size").alias("source_size"))
    targets = source_targets(totals, weights, most_epochs).select(F.col("source").alias("mix_name"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    lower = Window.partitionBy("mix_source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over buckets
    placed = histogram.join(targets, F.col("mix_source").eqNullSafe(F.col("mix_name"))).select(
        F.col("mix_source").alias("mix_name"), F.col("mix_bucket").alias("mix_at"), "mix_source_size", "mix_target", F.ceil(F.col("mix_rows") / rows_per_range).alias("mix_ranges"), F.coalesce(F.sum("mix_size").over(lower), F.lit(0)).alias("mix_before")
    )
    bounds = small(materialize(placed), most_broadcast)
    # where a key lies between its bucket's ends
    part = (F.col("mix_key") - F.exp(F.col("mix_bucket") / BUCKETS)) / (F.exp((F.col("mix_bucket") + 1) / BUCKETS) - F.exp(F.col("mix_bucket") / BUCKETS))
    return (
        keyed.join(bounds, F.col("mix_source").eqNullSafe(F.col("mix_name")) & (F.col("mix_bucket") == F.col("mix_at")))
        .drop("mix_name", "mix_at")
        .withColumn("mix_range", F.greatest(F.lit(0), F.least(F.col("mix_ranges") - 1, F.floor(part * F.col("mix_ranges")))))
    )


def mix_sources(
    docs: DataFrame,
    source: str = "source",
    size: str = "size",
    weight: str = "weight",
    draw: str = "draw",
    weights: tuple[int, ...] = WEIGHTS,
    most_epochs: int = MOST_EPOCHS,
    rows_per_range: int = 2_000,
    most_broadcast: int = 50_000,
) -> DataFrame:
    """``docs`` with ``mix_source_size``, ``mix_target``, ``mix_copies`` (whole copies taken) and ``mix_taken``.

    ``size`` is a long, ``weight`` a positive double, ``draw`` a double between 0 and 1 that a
    document's own content decides, so that reruns agree. A document is in the fractional epoch if
    the budget reaches its middle, so a source misses its target by half a document at most.

    Null sources are one source. Empty documents (size 0) take part and change nothing. Repeated rows
    each count; rows with equal keys are ordered by nothing else, as they are equal. An empty table
    gives an empty table. Other columns stay, but for those named ``mix_*``.
    """
    ranged = in_ranges(docs, source, size, weight, draw, weights, most_epochs, rows_per_range, most_broadcast)
    in_order = Window.partitionBy("mix_at_source", "mix_at_bucket").orderBy("mix_at_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.where("mix_ranges > 1")
        .groupBy(F.col("mix_source").alias("mix_at_source"), F.col("mix_bucket").alias("mix_at_bucket"), F.col("mix_range").alias("mix_at_range"))
        .agg(F.sum(size).alias("mix_at_size"))
        .withColumn("mix_start", F.coalesce(F.sum("mix_at_size").over(in_order), F.lit(0)))
        .drop("mix_at_size")
    )
    inside = Window.partitionBy("mix_source", "mix_bucket", "mix_range").orderBy("mix_key", draw).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    epochs = _epochs()
    summed = ranged.withColumn("mix_sum", F.sum(size).over(inside))
    budget = F.col("mix_target") - epochs * F.col("mix_source_size")
    middle = F.col("mix_before") + F.coalesce("mix_start", F.lit(0)) + F.col("mix_sum") - F.col(size) / 2.0
    copies = (epochs + F.when((epochs < most_epochs) & (middle <= budget), 1).otherwise(0)).cast("int")
    return (
        summed.join(starts, F.col("mix_source").eqNullSafe(F.col("mix_at_source")) & (F.col("mix_bucket") == F.col("mix_at_bucket")) & (F.col("mix_range") == F.col("mix_at_range")), "left")
        .withColumn("mix_copies", copies)
        .withColumn("mix_taken", F.col("mix_copies") * F.col(size))
        .drop("mix_at_source", "mix_at_bucket", "mix_at_range", "mix_key", "mix_source", "mix_bucket", "mix_ranges", "mix_before", "mix_range", "mix_start", "mix_sum")
    )


def cutoffs(mixed: DataFrame, source: str = "source", weight: str = "weight", draw: str = "draw") -> DataFrame:
    """A written table (mix_name, mix_epochs, mix_last) of each source of what ``mix_sources`` returns.

    The fractional epoch is a prefix of a source's keys, so its last (key, draw) says all of it; it is
    null where no document is in it.
    """
    at = F.struct(_key(weight, draw).alias("key"), F.col(draw).alias("draw"))
    return materialize(
        mixed.groupBy(F.col(source).alias("mix_name")).agg(F.max(_epochs()).cast("int").alias("mix_epochs"), F.max(F.when(F.col("mix_copies") > _epochs(), at)).alias("mix_last"))
    )


def take(docs: DataFrame, cuts: DataFrame, source: str = "source", weight: str = "weight", draw: str = "draw", most_broadcast: int = 10_000) -> DataFrame:
    """``docs`` with ``mix_copies`` by ``cutoffs``, as ``mix_sources`` gives them, but no document moves.

    Rows with equal keys (a document that repeats with its id) are in the fractional epoch together,
    if one of them is. Null sources are one source; an empty table gives an empty table.
    """
    at = F.struct(_key(weight, draw).alias("key"), F.col(draw).alias("draw"))
    copies = F.col("mix_epochs") + F.when(at <= F.col("mix_last"), 1).otherwise(0)
    found = docs.drop("mix_name", "mix_epochs", "mix_last", "mix_copies").join(small(cuts, most_broadcast), F.col(source).eqNullSafe(F.col("mix_name")))
    return found.withColumn("mix_copies", copies).drop("mix_name", "mix_epochs", "mix_last")


def with_draws(docs: DataFrame) -> DataFrame:
    """``docs`` with size, weight and draw as the query takes them: words, absence of junk, a hash of id and text."""
    return docs.withColumns(
        {
            "size": n_words(F.col("text")),
            "weight": quality_weight(F.col("text")),
            "draw": fraction(random_bits(SEED, F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit(""))))),
        }
    )


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_draws(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "weight", "draw")
    return mix_sources(materialize(docs)).select(
        "doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken")
    )


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    coalesce(greatest(0.05::DOUBLE, 1::DOUBLE - 4::DOUBLE * ((length(text) - length(translate(text, '{JUNK}', '')))::DOUBLE / greatest(length(text), 1)::DOUBLE)), 0.05::DOUBLE) AS weight,
    ((('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '~') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS draw
  FROM documents
), t AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
    row_number() OVER (ORDER BY source NULLS LAST) AS position, source_size * 3 AS cap, (sum(source_size) OVER ())::BIGINT AS all_size
  FROM t
), r AS (
  SELECT *,
    (all_size - coalesce(sum(cap) OVER (ORDER BY cap / weight::DOUBLE, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(weight) OVER (ORDER BY cap / weight::DOUBLE, position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w
), l AS (
  SELECT coalesce(arg_min(level, (cap / weight::DOUBLE, position)), 0) AS level FROM r WHERE level * weight <= cap
), g AS (
  SELECT w.source, w.source_size, least(w.cap::DOUBLE, l.level * w.weight) AS target FROM w, l
), k AS (
  SELECT d.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS epochs,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.draw) / d.weight, d.draw ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  ((epochs + CASE WHEN epochs < 3 AND upto - size / 2::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM k
"""
