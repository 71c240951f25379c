"""Uniform shuffling into shards of exact sizes by a hypergeometric communication matrix.

How many rows block b of the input sends to shard s is drawn first, for all b and s, from the
multivariate hypergeometric distribution that a uniform permutation of all rows would give. Then
every block permutes its own rows and cuts them at its row of the matrix, the rows are exchanged,
and every shard permutes what it got. The result is a uniform shuffle whose shard sizes are exact,
and no step sees more than one block or a range of one shard.

Only DataFrame functions are used. The matrix is drawn by halving: the counts of a range of blocks
are split between its halves, so that its depth is the logarithm of the number of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import fraction, materialize, random_bits, small, table

SHARDS = 40
SEED = 71


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` rows out of ``total`` are among the ``marked``, by inversion of ``u`` in (0, 1).

    The weights follow from each other by the ratio of neighbours, beginning 14 standard deviations
    (plus 14) from the mean, where nothing that a double could show is left out.
    """
    t, m, n = (c.cast("double") for c in (total, marked, drawn))
    mean = n * m / F.greatest(t, F.lit(1.0))
    spread = F.sqrt(mean * F.greatest(F.lit(0.0), 1 - m / F.greatest(t, F.lit(1.0))) * F.greatest(F.lit(0.0), t - n) / F.greatest(t - 1, F.lit(1.0)))
    reach = F.ceil(14 * spread + 14)
    low = F.greatest(F.lit(0), (drawn + marked - total), F.floor(mean) - reach).cast("long")
    high = F.least(marked, drawn, F.floor(mean) + reach).cast("long")
    steps = F.when(low < high, F.sequence(low + 1, high)).otherwise(F.array().cast("array<long>"))

    def ratio(k: Column) -> Column:
        return ((m - k + 1) * (n - k + 1)) / (k.cast("double") * (t - m - n + k))

    def add(a: Column, k: Column) -> Column:
        return F.struct((a.w * ratio(k)).alias("w"), (a.s + a.w * ratio(k)).alias("s"))

    def seek(a: Column, k: Column) -> Column:
        w = a.w * ratio(k)
        return F.struct(w.alias("w"), (a.s + w).alias("s"), F.when(a.s < a.goal, k).otherwise(a.k).alias("k"), a.goal.alias("goal"))

    whole = F.aggregate(steps, F.struct(F.lit(1e-280).alias("w"), F.lit(1e-280).alias("s")), add)
    start = F.struct(F.lit(1e-280).alias("w"), F.lit(1e-280).alias("s"), low.alias("k"), (u * whole.s).alias("goal"))
    return F.aggregate(steps, start, seek).k


def split_counts(row: Column, drawn: Column, draws: Column) -> Column:
    """Splits the counts ``row`` over shards: what ``drawn`` rows of them take from each shard, one shard after the other."""
    empty = F.array().cast("array<long>")
    start = F.struct(empty.alias("out"), F.aggregate(row, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), drawn.cast("long").alias("left"))

    def take(a: Column, x: Column) -> Column:
        k = hypergeometric(a.total, x.have, a.left, x.u)
        return F.struct(F.concat(a.out, F.array(k)).alias("out"), (a.total - x.have).alias("total"), (a.left - k).alias("left"))

    return F.aggregate(F.zip_with(row, draws, lambda h, u: F.struct(h.alias("have"), u.alias("u"))), start, take).out


def communication_matrix(counts: DataFrame, depth: int, shards: int, seed: int) -> DataFrame:
    """(shard_of, shard_ends) from (block, rows): ``shard_ends[s]`` rows of a block, in its own order, go to shards 0 to s.

    ``2 ** depth`` blocks; a block may be missing if it has no rows. One small array of block sizes is
    halved ``depth`` times.
    """
    sizes = counts.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("block", "rows"))).alias("rows"))
    every = F.transform(F.sequence(F.lit(0), F.lit(2**depth - 1)), lambda b: F.coalesce(F.try_element_at(F.col("rows"), b), F.lit(0).cast("long")))
    add = lambda a, x: a + x
    node = sizes.select(F.lit(0).alias("node"), every.alias("rows")).withColumn("all", F.aggregate("rows", F.lit(0).cast("long"), add))
    even = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor(F.col("all") / shards) + F.when(s < F.col("all") % shards, 1).otherwise(0))
    node = node.select("node", "rows", even.alias("row"))
    for level in range(depth):
        half = 2 ** (depth - level - 1)
        left = F.aggregate(F.slice("rows", 1, half), F.lit(0).cast("long"), add)
        draws = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s, n=level: fraction(random_bits(seed, "matrix", n, F.col("node"), s)))
        node = node.select("node", "rows", "row", split_counts(F.col("row"), left, draws).alias("first"))
        if level in (4, 9):  # the halves below are drawn in parallel
            node = node.repartition(2**level, "node")
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.slice("rows", 1, half).alias("rows"), F.col("first").alias("row")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.slice("rows", half + 1, half).alias("rows"), F.zip_with("row", "first", lambda a, b: a - b).alias("row")),
        )
        node = node.select(F.explode(halves).alias("h")).select("h.*")
    running = F.aggregate("row", F.array().cast("array<long>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long")) + x)))
    return node.select(F.col("node").alias("shard_of"), running.alias("shard_ends"))


def shuffle_into_shards(
    docs: DataFrame, keys: list[str], shards: int = SHARDS, seed: int = SEED, rows_per_block: int = 65_536, least_depth: int = 6, most_depth: int = 14, rows_per_range: int = 65_536
) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (from 0, without gaps), uniformly at random.

    Shard sizes are at most one apart; the first shards get what is over. ``keys`` are columns that
    tell rows apart: block and orders hang on their values and ``seed`` alone, so reruns and
    recomputed tasks agree. Rows that agree in all ``keys`` are ordered by nothing; they should be
    equal. Nulls in keys are values. An empty table gives an empty table; with fewer rows than shards
    the last shards stay empty. Other columns stay, but for those named ``shard``, ``slot`` or ``shard_*``.
    """
    docs = docs.drop("shard", "slot", *[c for c in docs.columns if c.lower().startswith("shard_")])
    rows = docs.count()
    depth = min(most_depth, max(least_depth, (max(1, rows) // rows_per_block).bit_length()))
    ranges = max(1, rows // shards // rows_per_range)
    at = [F.col(k) for k in keys]
    blocked = docs.withColumn("shard_block", (random_bits(seed, "block", *at) % (2**depth)).cast("int"))
    counts = blocked.groupBy(F.col("shard_block").alias("block")).agg(F.count(F.lit(1)).alias("rows"))
    matrix = small(materialize(communication_matrix(counts, depth, shards, seed)), 2**most_depth)
    # the first permutation, of each block
    own = Window.partitionBy("shard_block").orderBy(random_bits(seed, "first", *at), *at)
    sent = (
        blocked.withColumn("shard_place", F.row_number().over(own))
        .join(matrix, F.col("shard_block") == F.col("shard_of"))
        .withColumn("shard", F.size(F.filter("shard_ends", lambda end: end < F.col("shard_place"))))
        .drop("shard_of", "shard_ends", "shard_block", "shard_place")
        .withColumn("shard_bits", random_bits(seed, "second", *at))
        .withColumn("shard_range", F.floor(F.col("shard_bits") * F.lit(float(ranges)) / float(1 << 52)).cast("int"))
    )
    # the second one, of each shard, by ranges of its random keys
    before = Window.partitionBy("shard_in_shard").orderBy("shard_in_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sent.groupBy(F.col("shard").alias("shard_in_shard"), F.col("shard_range").alias("shard_in_range"))
        .agg(F.count(F.lit(1)).alias("shard_in_rows"))
        .withColumn("shard_in_start", F.coalesce(F.sum("shard_in_rows").over(before), F.lit(0)))
        .drop("shard_in_rows")
    )
    inside = Window.partitionBy("shard", "shard_range").orderBy("shard_bits", *at)
    return (
        sent.withColumn("slot", F.row_number().over(inside).cast("long") - 1)
        .join(starts, (F.col("shard") == F.col("shard_in_shard")) & (F.col("shard_range") == F.col("shard_in_range")))
        .withColumn("slot", F.col("slot") + F.col("shard_in_start"))
        .drop("shard_in_shard", "shard_in_range", "shard_in_start", "shard_bits", "shard_range")
    )


def op1_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by the law ``rows``; a null text has size 16 and a null text_crc32."""
    text = F.col("text").cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffle_into_shards(docs, ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
