"""Hard-negative mining by a table of distances to pivots.

One more component turns inner products into distances: a row is filled up to the longest norm M and
an anchor gets 0, so that |x' - a'|^2 = M^2 + |a|^2 - 2 x.a. The table holds each row's distances to
a few pivots. By the triangle inequality the distances of a row and an anchor to a pivot bracket
their own distance, and so their score. Rows whose bracket can't reach what is asked for are passed
over; the others get their exact score, in whole numbers.

Anchors and rows are dealt by a hash in blocks of bounded size, whatever their labels, and each pair
of blocks is one group. A group keeps only what can still be among the first of an anchor, and these
few meet in a window.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm.common import bound_batches, materialize, settle, table

#: How many pivots there are, and the rows from which they are picked.
PIVOTS, SAMPLE = 8, 1024
#: Rows and anchors of a group.
ROW_BLOCK, ANCHOR_BLOCK = 4096, 512
POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between this share, in hundredths, of the positive's and the positive's.
LEAST_SHARE = 80
_LONG = 1 << 63
_WANTED = "array<struct<at:int,score:long,id:long>>"
_POSITIVES = "anchor long, row long, id long, score long"
_NEGATIVES = "anchor long, row long, at int, positive long, positive_score long, id long, score long"


def usable(vectors: DataFrame, key: str, vector: str, label: str, anchor: Column) -> DataFrame:
    """(id, label, vector, anchor, row) of the rows that take part, each once; row is a hash of the row."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = kept.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    return rows.distinct().withColumn("row", F.xxhash64("id", "label", "vector", "anchor"))


@F.arrow_udf(StructType([StructField("largest", DoubleType()), StructField("norm", DoubleType())]))
def _measured(vectors: pa.Array) -> pa.Array:
    """No less than the largest whole component, 1 at least, and no less than the norm of each vector."""
    n, lengths = len(vectors), vectors.value_lengths().to_numpy(zero_copy_only=False)
    largest, norm = np.ones(n), np.zeros(n)
    flat = np.minimum(np.abs(vectors.flatten().to_numpy(zero_copy_only=False)), 1e305) * 256 + 1
    some, begin = lengths > 0, np.cumsum(lengths) - lengths
    if some.any():
        largest[some] = np.maximum.reduceat(flat, begin[some])
        norm[some] = largest[some] * np.sqrt(np.add.reduceat((flat / np.repeat(largest, lengths)) ** 2, begin[some]))
    return pa.StructArray.from_arrays([pa.array(largest), pa.array(norm)], ["largest", "norm"])


@dataclass(frozen=True)
class Space:
    """The augmented space in units of the largest component: its dimension, the square of the longest norm, the pivots."""

    dim: int
    unit: float
    most: float
    pivots: np.ndarray

    def scaled(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors of whole components in units, which no square of a component leaves."""
        return np.floor(np.clip(vectors, -1e305, 1e305) * 256) / self.unit

    def distances(self, vectors: np.ndarray, anchor: bool) -> np.ndarray:
        """Of each vector to each pivot; rows are filled up, anchors are not."""
        y = self.scaled(vectors)
        fill = np.zeros(len(y)) if anchor else np.sqrt(np.maximum(self.most - (y * y).sum(1), 0))
        return np.sqrt(((np.column_stack([y, fill])[:, None, :] - self.pivots[None]) ** 2).sum(2))

    def bracket(self, rows: np.ndarray, anchor: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score that distances to the pivots leave possible; what doubles lose on the way is added."""
        near, far = np.abs(rows - anchor).max(1), (rows + anchor).min(1)
        slack = 1e-9 * (self.most + norm)
        with np.errstate(over="ignore", invalid="ignore"):
            least, largest = (((self.most + norm - d * d) / 2 + s) * self.unit * self.unit for d, s in ((far, -slack), (near, slack)))
        return np.clip(least, -_LONG, _LONG), np.clip(largest, -_LONG, _LONG)


def pick(sample: np.ndarray, space: Space, pivots: int) -> np.ndarray:
    """Rows of the sample that are far from each other in the augmented space, one after the other."""
    y = space.scaled(sample)
    y = np.column_stack([y, np.sqrt(np.maximum(space.most - (y * y).sum(1), 0))])
    chosen, far = [0], np.full(len(y), np.inf)
    while len(chosen) < min(pivots, len(y)):
        far = np.minimum(far, ((y - y[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(far.argmax()))
    return y[chosen]


def _whole(vectors: np.ndarray) -> list[list[int]]:
    """floor(256 x) of doubles of any size, as whole numbers of any size."""
    return [[math.floor(x * 256) if abs(x) < 1e300 else int(x) * 256 for x in row] for row in vectors.tolist()]


class _Side:
    """Rows or anchors of a group, by label and id."""

    def __init__(self, rows: pa.Table, dim: int):
        order = np.lexsort((rows.column("id").to_numpy(), rows.column("label").to_numpy()))
        self.rows = rows.take(pa.array(order))
        self.id, self.row, self.label = (self.rows.column(c).to_numpy() for c in ("id", "row", "label"))
        of = lambda c, n: np.frombuffer(b"".join(self.rows.column(c).to_pylist()), np.float64).reshape(len(order), n)
        self.vectors = of("vector", dim)
        self.pivots = of("pivots", -1) if len(order) else np.zeros((0, 1))

    def largest(self) -> float:
        return float(np.abs(self.vectors).max(initial=0)) * 256 + 1


def _scorer(rows: _Side, anchors: _Side, dim: int):
    """A function from (places of rows, place of an anchor) to their exact scores; a score beyond a long is the nearest long."""
    if dim * rows.largest() * anchors.largest() < 1 << 53:  # all sums are whole doubles
        x, q = np.floor(rows.vectors * 256), np.floor(anchors.vectors * 256)
        return lambda at, k: (x[at] @ q[k]).astype(np.int64)
    asked = _whole(anchors.vectors)

    def exact(at: np.ndarray, k: int) -> np.ndarray:
        found = [sum(a * b for a, b in zip(row, asked[k], strict=True)) for row in _whole(rows.vectors[at])]
        return np.array([max(-_LONG, min(_LONG - 1, s)) for s in found], np.int64)

    return exact


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, of equal ones the smaller ids."""
    return np.lexsort((ids, ~scores))[:k]


def _reach(sure: np.ndarray, largest: np.ndarray, k: int) -> np.ndarray:
    """Which rows can be among the k first, given scores of which some rows are sure."""
    if len(sure) < k:
        return np.ones(len(largest), bool)
    return ~(largest < np.partition(sure, -k)[-k])


def _positives(space: Space, k: int):
    def run(group: pa.Table) -> pa.Table:
        rows, anchors = (_Side(group.filter(pa.array(group.column("asks").to_numpy() == x)), space.dim) for x in (False, True))
        score = _scorer(rows, anchors, space.dim)
        out: list[tuple] = []
        for a in range(len(anchors.id)):
            low, high = np.searchsorted(rows.label, anchors.label[a], "left"), np.searchsorted(rows.label, anchors.label[a], "right")
            at = np.arange(low, high)[rows.id[low:high] != anchors.id[a]]
            if len(at):
                norm = float((space.scaled(anchors.vectors[a : a + 1]) ** 2).sum())
                least, largest = space.bracket(rows.pivots[at], anchors.pivots[a], norm)
                at = at[_reach(least, largest, k)]
                found = score(at, a)
                best = _first(found, rows.id[at], k)
                out.append((np.full(len(best), anchors.id[a]), np.full(len(best), anchors.row[a]), rows.id[at[best]], found[best]))
        return _table(out, ("anchor", "row", "id", "score"), ())

    return run


def _negatives(space: Space, k: int, share: int):
    def run(group: pa.Table) -> pa.Table:
        rows, anchors = (_Side(group.filter(pa.array(group.column("asks").to_numpy() == x)), space.dim) for x in (False, True))
        score, out = _scorer(rows, anchors, space.dim), []
        wanted = anchors.rows.column("wanted").to_pylist()
        for a in range(len(anchors.id)):
            norm = float((space.scaled(anchors.vectors[a : a + 1]) ** 2).sum())
            other = np.flatnonzero((rows.label != anchors.label[a]) & (rows.id != anchors.id[a]))
            least, largest = space.bracket(rows.pivots[other], anchors.pivots[a], norm)
            windows = [(w, -(-share * w["score"] // 100), w["score"]) for w in wanted[a]]
            asked = np.zeros(len(other), bool)
            for _, low, high in windows:
                if low <= high:
                    may = ~(largest < low) & ~(least > high)
                    asked |= may & _reach(least[(least >= low) & (largest <= high)], largest, k)
            at = other[asked]
            found = score(at, a)
            for w, low, high in windows:
                inside = np.flatnonzero((found >= low) & (found <= high))
                best = inside[_first(found[inside], rows.id[at[inside]], k)]
                n = len(best)
                out.append((np.full(n, anchors.id[a]), np.full(n, anchors.row[a]), np.full(n, w["at"]), np.full(n, w["id"]), np.full(n, w["score"]), rows.id[at[best]], found[best]))
        return _table(out, ("anchor", "row", "at", "positive", "positive_score", "id", "score"), ("at",))

    return run


def _table(parts: list[tuple], names: tuple[str, ...], ints: tuple[str, ...]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * len(names)
    return pa.table({name: pa.array(c, pa.int32() if name in ints else pa.int64()) for name, c in zip(names, columns, strict=True)})


def mine(
    vectors: DataFrame,
    anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_share: int = LEAST_SHARE,
    pivots: int = PIVOTS,
    row_block: int = ROW_BLOCK,
    anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hard negatives of each anchor and positive.

    Scores are inner products of floor(256 x), exactly; one that a long can't hold counts as the nearest
    long. An anchor's positives are its first ``positives`` rows of its label and another id, by falling
    score, then rising id. Its hard negatives for a positive are the first ``negatives`` rows of other
    labels whose score is at most the positive's and at least ``least_share`` hundredths of it; for a
    positive of a score below 0 there are none.

    Null keys, labels and vectors, vectors with null or non-finite components, and those of another
    length than the most frequent one (of equally frequent ones the largest) take no part. Equal rows
    count once; rows that share an id but differ are rows of their own, and no row answers its own id.
    An empty table, or one without anchors, gives no rows. Other columns play no part.
    """
    build = lambda: _mine(vectors, anchor, key, vector, label, positives, negatives, least_share, pivots, row_block, anchor_block)
    return settle(vectors.sparkSession, build)


def _mine(vectors: DataFrame, anchor: Column, key: str, vector: str, label: str, positives: int, negatives: int, least_share: int, pivots: int, row_block: int, anchor_block: int) -> DataFrame:
    spark = vectors.sparkSession
    bound_batches(spark)
    base = materialize(usable(vectors, key, vector, label, anchor))
    facts = base.select(F.size("vector").alias("dim"), "anchor", _measured(F.col("vector")).alias("m")).groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors"), F.max("m.largest").alias("unit"), F.max("m.norm").alias("longest"))
    fact = facts.orderBy(F.desc("n"), F.desc("dim")).first()
    if fact is None or not fact["anchors"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    unit = min(fact["unit"], 1e305)
    space = Space(fact["dim"], unit, float(min(fact["longest"] / unit, math.sqrt(fact["dim"]) * 2) ** 2), np.zeros((0, fact["dim"] + 1)))
    rows = base.where(F.size("vector") == fact["dim"])
    sample = np.array([r["vector"] for r in rows.orderBy(F.xxhash64("row"), "id").limit(SAMPLE).select("vector").collect()], np.float64).reshape(-1, fact["dim"])
    space = Space(space.dim, space.unit, space.most, pick(sample, space, pivots))

    def placed(asks: bool):
        @F.arrow_udf("struct<vector:binary,pivots:binary>")
        def run(column: pa.Array) -> pa.Array:
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            far = np.concatenate([np.zeros((0, len(space.pivots))), *[space.distances(x[i : i + 1024], asks) for i in range(0, len(x), 1024)]])
            return pa.StructArray.from_arrays([pa.array([r.tobytes() for r in m], pa.binary()) for m in (x, far)], ["vector", "pivots"])

        return run

    row_blocks, anchor_blocks = math.ceil(fact["n"] / row_block), math.ceil(fact["anchors"] / anchor_block)
    block = lambda n: F.pmod(F.xxhash64("row", F.lit("block")), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def pairs(anchors: DataFrame) -> DataFrame:
        """The groups of blocks; ``anchors`` has the rows that ask, with what is wanted for them."""
        own = rows.select("id", "row", "label", placed(False)(F.col("vector")).alias("z"), F.lit(None).cast(_WANTED).alias("wanted"), F.lit(False).alias("asks"), block(row_blocks).alias("rb")).select("*", every(anchor_blocks).alias("ab"))
        asking = anchors.select("id", "row", "label", placed(True)(F.col("vector")).alias("z"), "wanted", F.lit(True).alias("asks"), block(anchor_blocks).alias("ab")).select("*", every(row_blocks).alias("rb"))
        return own.unionByName(asking).select("id", "row", "label", "z.vector", "z.pivots", "wanted", "asks", "ab", "rb").groupBy("ab", "rb")

    anchors = rows.where("anchor")
    near = pairs(anchors.withColumn("wanted", F.lit(None).cast(_WANTED))).applyInArrow(_positives(space, positives), _POSITIVES)
    order = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    first = near.withColumn("at", order("anchor", "row")).where(F.col("at") <= positives)
    wanted = materialize(first.groupBy(F.col("anchor").alias("id"), "row").agg(F.collect_list(F.struct("at", "score", "id")).alias("wanted")))
    hard = pairs(anchors.join(wanted, ["id", "row"])).applyInArrow(_negatives(space, negatives, least_share), _NEGATIVES)
    ranked = hard.withColumn("rank", order("anchor", "row", "at")).where(F.col("rank") <= negatives)
    return ranked.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("vec_id")
    moved = F.when(id_ % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return mine(vectors, id_ % 100 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_sum([a.x[i] * b.x[i] FOR i IN range(1, len(a.x) + 1)])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), n AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
) SELECT * FROM n WHERE rank <= 5
"""
