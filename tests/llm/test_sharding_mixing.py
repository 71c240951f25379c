import collections
import hashlib
import random

import pytest
from compare import DATA, check
from pyspark.sql import functions as F

from tessera.llm import mixing, sharding
from tessera.llm.common import fraction, random_bits


def rows_of(spark, n, extra=()):
    return spark.createDataFrame([(i, i % 7, f"x{i}") for i in range(n)] + list(extra), "doc_id long, size long, shard_block string")


@pytest.mark.parametrize("n", [0, 1, 39, 500])
def test_shards_are_exact_and_slots_gapless(spark, n):
    got = sharding.shuffle_into_shards(rows_of(spark, n), ["doc_id"], rows_per_range=3).collect()
    assert len(got) == n and "shard_block" not in sharding.shuffle_into_shards(rows_of(spark, 1), ["doc_id"]).columns
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(40))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_repeated_rows_and_nulls_are_kept(spark):
    docs = rows_of(spark, 5, [(None, None, None)] * 3 + [(2, 2, "x2")] * 4)
    got = sharding.shuffle_into_shards(docs, ["doc_id", "size"], shards=3)
    assert collections.Counter((r["doc_id"], r["size"]) for r in got.collect())[(2, 2)] == 5 and got.count() == 12


def test_hypergeometric_draws_follow_the_distribution(spark):
    t, m, n, draws = 60, 25, 18, 4000
    got = spark.range(draws).select(sharding.hypergeometric(F.lit(t).cast("long"), F.lit(m).cast("long"), F.lit(n).cast("long"), fraction(random_bits("t", F.col("id")))).alias("k"))
    values = [r["k"] for r in got.collect()]
    mean, var = n * m / t, n * (m / t) * (1 - m / t) * (t - n) / (t - 1)
    found = sum(values) / draws
    assert abs(found - mean) < 5 * (var / draws) ** 0.5
    assert sum((v - found) ** 2 for v in values) / draws == pytest.approx(var, rel=0.15)
    sure = spark.range(3).select(*[sharding.hypergeometric(*[F.lit(x).cast("long") for x in a], F.lit(0.5)).alias(f"c{i}") for i, a in enumerate(((10, 10, 4), (10, 0, 4), (10, 3, 10), (0, 0, 0)))])
    assert tuple(sure.first()) == (4, 0, 3, 0)


def test_shards_are_uniform(spark):
    """The chi-square statistic of id residues against shards stays near its degrees of freedom."""
    got = sharding.shuffle_into_shards(rows_of(spark, 4000), ["doc_id"], shards=8)
    counts = collections.Counter((r["doc_id"] // 500, r["shard"]) for r in got.collect())
    chi = sum((counts[a, b] - 62.5) ** 2 / 62.5 for a in range(8) for b in range(8))
    assert chi < 49 + 5 * (2 * 49) ** 0.5


def bits(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def test_shuffle_equals_one_by_hand(spark):
    """Blocks, cuts and both permutations again in plain Python, with the drawn matrix; more blocks than one round of halving draws at once."""
    n, shards, seed, depth = 400, 7, 71, 7
    blocks = collections.defaultdict(list)
    for i in range(n):
        blocks[bits(seed, "block", i) % 2**depth].append(i)
    counts = spark.createDataFrame([(b, len(v)) for b, v in blocks.items()], "block int, rows long")
    ends = {r["shard_of"]: r["shard_ends"] for r in sharding.communication_matrix(counts, depth, shards, seed).collect()}
    assert all(ends[b][-1] == len(v) for b, v in blocks.items()) and len(ends) == 2**depth
    sent = collections.defaultdict(list)
    for b, own in blocks.items():
        for place, i in enumerate(sorted(own, key=lambda i: (bits(seed, "first", i), i)), 1):
            sent[sum(end < place for end in ends[b])].append(i)
    assert sorted(map(len, sent.values())) == [57] * 6 + [58]
    want = {i: (s, slot) for s, own in sent.items() for slot, i in enumerate(sorted(own, key=lambda i: (bits(seed, "second", i), i)))}
    got = sharding.shuffle_into_shards(rows_of(spark, n), ["doc_id"], shards=shards, seed=seed, rows_per_block=4, rows_per_range=20).collect()
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == want


def test_op1_returns_all_documents(spark):
    sf = str(DATA / "sf0.001")
    got = sharding.op1_shard_documents(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    expected = docs.select("doc_id", (F.octet_length("text") + 16).cast("long"), F.crc32(F.col("text").cast("binary")))
    assert sorted(map(tuple, got.select("doc_id", "size", "text_crc32").collect())) == sorted(map(tuple, expected.collect()))


def test_op8_equals_sql(spark):
    check(spark, mixing.op8_mix_sources, mixing.ORACLE_SQL, "sf0.01")


def targets(sizes):
    """Brute force: fill up by weight until no target is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 3, 50, 4000, 10**6]) for s in [None, "", *"abcdefé"]}
    frame = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, rows long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    assert got == pytest.approx(targets(sizes), rel=1e-9, abs=1e-6)


def test_mix_of_odd_rows(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (3, "", None), (None, "x " * 400, None), (4, "|||| 123 |||", "t"), (5, "y", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mix_range", F.lit("own")).withColumn("at_source", F.lit("kept"))
    for ranges in (1, 1000):
        got = mixing.mix_sources(mixing.with_draws(docs), rows_per_range=ranges).collect()
        assert len(got) == len(rows) and all(0 <= r["mix_taken"] <= 3 * r["size"] and r["at_source"] == "kept" for r in got)
    assert mixing.mix_sources(mixing.with_draws(docs.limit(0))).count() == 0


def test_ranges_change_nothing(spark):
    docs = mixing.with_draws(spark.read.parquet(str(DATA / "sf0.001/documents.parquet")))
    one, many = (sorted(map(tuple, mixing.mix_sources(docs, rows_per_range=n).select("doc_id", "mix_taken").collect())) for n in (10**6, 3))
    assert one == many


def test_cutoffs_take_what_the_mix_takes(spark):
    docs = mixing.with_draws(spark.read.parquet(str(DATA / "sf0.001/documents.parquet")))
    rows = [(None, "x y z", None, 1), (7, None, "s", 1), (8, "", "t", 1), (9, "a b", "t", 1), (10, "c d e f", "t", 1)]
    odd = mixing.with_draws(spark.createDataFrame(rows, "doc_id long, text string, source string, mix_last int"))
    for frame in (docs, odd, odd.limit(0)):
        mixed = mixing.mix_sources(frame)
        taken = mixing.take(frame, mixing.cutoffs(mixed))
        assert sorted(map(repr, taken.select("doc_id", "mix_copies").collect())) == sorted(map(repr, mixed.select("doc_id", "mix_copies").collect()))


def test_repeats_are_taken_together(spark):
    docs = mixing.with_draws(spark.createDataFrame([(1, "a b c", s) for s in "uuuuvvvvwwww"], "doc_id long, text string, source string"))
    taken = mixing.take(docs, mixing.cutoffs(mixing.mix_sources(docs))).collect()
    assert len(taken) == 12 and all(len({r["mix_copies"] for r in taken if r["source"] == s}) == 1 and max(r["mix_copies"] for r in taken) <= 3 for s in "uvw")


@pytest.mark.parametrize("weight", [1.0, 0.05, 7.0])
def test_ranges_are_even_whatever_the_weights(spark, weight):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(3).cast("long").alias("size"), F.lit(weight).alias("weight"), mixing.fraction(mixing.random_bits("t", F.col("id"))).alias("draw"))
    found = mixing.in_ranges(docs, "source", "size", "weight", "draw", mixing.WEIGHTS, mixing.MOST_EPOCHS, 100, 50_000)
    rows = sorted(r["count"] for r in found.groupBy("mix_bucket", "mix_range").count().collect())
    assert sum(rows) == 40_000 and rows[-1] <= 200
