"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree gives a vector a long string of bits, the sides of random hyperplanes, and is a sorted
array of these strings, cut into cells by their first bits. A query descends to the longest prefixes
that others share with it and ascends in all trees at once, one bit at a time, until the matches of
all trees together are as many as wanted. The matches of that prefix length, a range of each sorted
array, are compared with the query.

Trees hold ids, strings and vectors in sixteen bits a component, so that the vectors themselves are
neither copied for each tree nor moved before the end. Comparisons in sixteen bits have an error with
a known bound: a match leaves its task if that error could hide it among the nearest, and the few
that are left meet the original vectors for their exact scores.

The matches of each length come from counts of prefixes, so no task sees a whole tree. Cells with
many vectors or many queries are cut by hashes, and each part of the ones meets each of the others. Of equal vectors only the first by id can be among the nearest, so
no more of them than results enter the forest; equal queries are searched once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, settle, small, table

NEAREST = 20
TREES, BITS, SEED = 24, 30, 5
#: Matches wanted in all trees together: a number, and a share of all vectors beyond it. Vectors without
#: any structure need this much for a recall of 0.9; where neighbours stand out, a small share does.
MATCHES, SHARE = 4000, 0.45
#: Vectors and queries of a cell that one group takes.
CELL_ROWS, CELL_QUERIES = 8192, 4096


def clean(vectors: DataFrame, vector: str) -> DataFrame:
    """Without null and zero vectors and those with null or non-finite components; components are doubles."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)).withColumn(vector, F.transform(v.cast("array<double>"), lambda x: F.when(x == 0, 0.0).otherwise(x)))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def hasher(dim: int, longest: float, trees: int, bits: int, seed: int, query: bool):
    """A UDF from vectors to (keys: their strings, a long for each tree; code, unit: the vector as whole numbers of a unit).

    Inner products become angles by one more component, which fills a vector up to the longest norm and
    is 0 for queries. The code has 16-bit numbers; for queries it is the vector itself, of unit 1.
    """
    planes = np.random.default_rng(seed).standard_normal((dim + 1, trees * bits))
    weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)

    @F.arrow_udf("struct<keys:array<long>,code:binary,unit:double>")
    def run(vectors: pa.Array) -> pa.Array:
        x = _matrix(vectors)
        filled = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))
        keys = np.concatenate([(np.column_stack([x[i : i + 4096], filled[i : i + 4096]]) @ planes > 0).reshape(-1, trees, bits) @ weights for i in range(0, len(x), 4096)]) if len(x) else np.zeros((0, trees), np.int64)
        unit = np.ones(len(x)) if query else np.abs(x).max(1, initial=0) / 32767
        code = x if query else np.round(x / unit[:, None]).astype(np.int16)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * trees), pa.array(keys.ravel()))
        return pa.StructArray.from_arrays([lists, pa.array([row.tobytes() for row in code], pa.binary()), pa.array(unit)], ["keys", "code", "unit"])

    return run


def prefix_counts(keyed: DataFrame, trees: int, bits: int, deepest: int) -> DataFrame:
    """(tree, depth, prefix, n) for all depths to ``deepest``; each batch is counted before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _matrix(batch.column(0))
            for tree in range(trees if len(keys) else 0):
                for depth in range(deepest + 1):
                    prefix, n = np.unique(keys[:, tree] >> (bits - depth), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"tree": pa.array([tree] * len(n), pa.int32()), "depth": pa.array([depth] * len(n), pa.int32()), "prefix": pa.array(prefix), "n": pa.array(n)})

    return keyed.select("keys").mapInArrow(run, "tree int, depth int, prefix long, n long").groupBy("tree", "depth", "prefix").agg(F.sum("n").alias("n"))


def _search(bits: int, most: int):
    """(query, vec_id, rough, slack) of the matches in one part of a cell that may be among the ``most`` nearest; the score, over the query's largest component, is within slack of rough."""

    def run(group: pa.Table) -> pa.Table:
        wanted = group.column("depth").to_numpy()
        points, queries = group.filter(pa.array(wanted < 0)).sort_by("key"), group.filter(pa.array(wanted >= 0))
        out: list[tuple[np.ndarray, ...]] = []
        if len(points) and len(queries):
            key, ids, unit = (points.column(c).to_numpy() for c in ("key", "id", "unit"))
            own, own_key, depth = (queries.column(c).to_numpy() for c in ("id", "key", "depth"))
            x = np.frombuffer(b"".join(points.column("code").to_pylist()), np.int16).reshape(len(ids), -1).astype(np.float32)
            q = np.frombuffer(b"".join(queries.column("code").to_pylist()), np.float64).reshape(len(own), -1)
            # a query's length changes no order, so its largest component becomes 1, which 32 bits can hold whatever it was;
            # half a unit in every component, and the rounding of sums in 32 bits
            q = q / np.abs(q).max(1, keepdims=True)
            size = np.abs(q).sum(1)
            slack = unit * (0.5 + 32767 * (x.shape[1] + 2) * float(np.finfo(np.float32).eps))
            shift = bits - depth
            low, high = np.searchsorted(key, (own_key >> shift) << shift), np.searchsorted(key, ((own_key >> shift) + 1) << shift)
            thin = q.astype(np.float32)
            for k in np.flatnonzero(low < high).tolist():
                at = slice(low[k], high[k])
                rough, error = (x[at] @ thin[k]).astype(np.float64) * unit[at], slack[at] * size[k]
                if len(rough) > most:
                    sure = rough - error
                    kept = np.flatnonzero(rough + error >= np.partition(sure, -most)[-most])
                else:
                    kept = np.arange(len(rough))
                out.append((np.full(len(kept), own[k]), ids[at][kept], rough[kept], error[kept]))
        empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else empty
        return pa.table({name: pa.array(c, t) for name, c, t in zip(("query", "vec_id", "rough", "slack"), columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)})

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = NEAREST, trees: int = TREES, bits: int = BITS, matches: int = MATCHES, share: float = SHARE, cell_rows: int = CELL_ROWS, cell_queries: int = CELL_QUERIES, seed: int = SEED
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each query, its own row left out.

    Ties go to the smaller id. Vectors that are null, zero, hold nulls or non-finite components, or
    are of another length than the most frequent one (of equally frequent ones the largest), take no part on either side; neither do null ids.
    An empty table, or one without other vectors, gives no rows. Rows that repeat an id are one
    candidate. Ids are longs.
    """
    return settle(vectors.sparkSession, lambda: _nearest(vectors, queries, key, vector, k, trees, bits, matches, share, cell_rows, cell_queries, seed))


def _nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, trees: int, bits: int, matches: int, share: float, cell_rows: int, cell_queries: int, seed: int) -> DataFrame:
    usable = clean(vectors.where(F.col(key).isNotNull()), vector).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    lengths = usable.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("longest")).orderBy(F.desc("n"), F.desc("dim")).first()
    spark = vectors.sparkSession
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, longest = lengths["dim"], lengths["longest"]
    copies = Window.partitionBy("vector").orderBy("id")
    kept = usable.where(F.size("vector") == dim).distinct().withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    points = materialize(kept.withColumn("h", hasher(dim, longest, trees, bits, seed, False)(F.col("vector"))).select("id", "vector", "h.*"))
    asked = clean(queries.where(F.col(key).isNotNull()), vector).select(F.col(key).cast("long").alias("query_id"), F.col(vector).alias("vector")).where(F.size("vector") == dim).distinct()
    distinct = asked.groupBy("vector").agg(F.min("query_id").alias("id"))
    searched = materialize(distinct.withColumn("h", hasher(dim, longest, trees, bits, seed, True)(F.col("vector"))).select("id", "vector", "h.*"))

    n = points.count()
    wanted = max(k + 1, matches + share * n)
    level = max(0, min(bits, int(math.log2(max(1.0, trees * n / wanted)))))
    deepest = min(bits, level + 6)
    counts = materialize(prefix_counts(points, trees, bits, deepest))
    # the longest prefix at which all trees together have enough matches; all vectors match a prefix of 0 bits
    steps = searched.select("id", F.posexplode("keys").alias("tree", "key")).withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(deepest))))
    steps = steps.withColumn("prefix", F.expr(f"shiftright(key, {bits} - depth)"))
    matched = steps.join(small(counts, 200_000), ["tree", "depth", "prefix"]).groupBy("id", "depth").agg(F.sum("n").alias("matches"))
    depths = matched.where(F.col("matches") >= F.least(F.lit(wanted), F.lit(float(trees * n)))).groupBy("id").agg(F.max("depth").alias("depth"))

    # cells of the first ``level`` bits, large ones in parts; a query that ascended further visits more cells
    up = f"greatest(0, {level} - depth)"
    calls = (
        searched.join(depths, "id")
        .select("id", "code", "unit", "depth", F.posexplode("keys").alias("tree", "key"))
        .withColumn("below", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"shiftleft(1L, {up}) - 1"))))
        .withColumn("cell", F.expr(f"shiftleft(shiftright(key, {bits - level} + {up}), {up}) + below"))
    )
    called = calls.groupBy("tree", "cell").agg(F.count(F.lit(1)).alias("calls"))
    held = counts.where(F.col("depth") == level).select("tree", F.col("prefix").alias("cell"), F.ceil(F.col("n") / cell_rows).alias("parts"))
    cells = held.join(called, ["tree", "cell"]).select(F.col("tree").alias("of_tree"), F.col("cell").alias("of_cell"), "parts", F.ceil(F.col("calls") / cell_queries).alias("sides"))
    cells = small(materialize(cells), 200_000)
    in_cell = (F.col("tree") == F.col("of_tree")) & (F.col("cell") == F.col("of_cell"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one_of = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    placed = (
        points.select("id", "code", "unit", F.posexplode("keys").alias("tree", "key"))
        .withColumn("cell", F.expr(f"shiftright(key, {bits - level})"))
        .join(cells, in_cell)
        .select("tree", "cell", one_of("parts").alias("part"), each("sides").alias("side"), "id", "key", F.lit(-1).alias("depth"), "code", "unit")
    )
    visits = calls.join(cells, in_cell).select("tree", "cell", each("parts").alias("part"), one_of("sides").alias("side"), "id", "key", "depth", "code", "unit")
    found = placed.unionByName(visits).groupBy("tree", "cell", "part", "side").applyInArrow(_search(bits, k + 1), "query long, vec_id long, rough double, slack double")
    # one row for each match, those that can still be among the nearest, then their exact scores
    once = found.groupBy("query", "vec_id").agg(F.max("rough").alias("rough"), F.max("slack").alias("slack"))
    sure = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.col("rough") - F.col("slack"))))
    least = F.min(F.when(F.col("at") <= k + 1, F.col("rough") - F.col("slack"))).over(Window.partitionBy("query"))
    few = once.withColumn("at", sure).withColumn("least", least).where(F.col("rough") + F.col("slack") >= F.col("least")).select("query", "vec_id")
    scored = few.join(points.select(F.col("id").alias("vec_id"), "vector"), "vec_id").join(searched.select(F.col("id").alias("query"), F.col("vector").alias("asked")), "query")
    score = F.aggregate(F.zip_with("vector", "asked", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    by_score = [F.desc("score"), F.asc("vec_id")]
    best = scored.select("query", "vec_id", score.alias("score")).withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(*by_score))).where(F.col("at") <= k + 1).drop("at")
    of_class = asked.join(distinct.withColumnRenamed("vector", "same"), F.col("vector") == F.col("same")).select("query_id", F.col("id").alias("class"))
    each = of_class.join(best, F.col("class") == F.col("query")).where(F.col("vec_id") != F.col("query_id"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by_score)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
