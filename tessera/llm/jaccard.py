"""Jaccard join on word n-grams as a blocked sparse product of documents by n-grams.

The overlaps of all pairs are the product of the incidence matrix with its transpose. Bounds from
the sizes of sets keep it small, and none of them loses a link:

* A set can only link if ``threshold`` of it recurs somewhere, so documents are first asked for the
  document counts of their n-grams, and most drop out. The counts also order the n-grams of each set,
  so that no n-gram is counted again.
* Equal sets become one row (a class).
* Two sets that link share one of their rarest n-grams, within the first ``n - ceil(t n) + 1``.
  Connecting classes by these splits the matrix into diagonal blocks.

Each block is multiplied by tiles of classes in the order of their sizes; overlap counts accumulate
over ranges of n-grams, and pairs below the bound are discarded inside the task. A tile is bounded by
the classes and by the n-grams that it holds, and returns the components of its links, not its pairs.
In a large block every class meets a few pivots first, and tiles whose classes the pivots have
already joined are not multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import blocks as B
from tessera.llm import text as T
from tessera.llm.common import drop, materialize, settle, small, table
from tessera.llm.components import components

WORDS = 5
PERCENT = 80
#: Classes of a tile (a class counts once more for every ``PER_CLASS`` n-grams), n-grams that one step of
#: a product takes, and pivots of a large block.
TILE, PER_CLASS, COLUMNS, PIVOTS = 128, 1024, 4096, 8
#: Bits to spare in the first question: n-grams that share its bits count together, which lets through
#: more documents, never fewer; all that follows takes the whole hash.
SPARE = 8
_DOCS = "block long, at int, doc_id long, n_shingles long, class long, check long, shingles array<long>"
#: Rows that a side of a join may have to be broadcast; a row of these tables has a few numbers.
MOST_BROADCAST = 50_000


def _sets(words: T.Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, which text each belongs to, where texts' begin) of the distinct n-grams of each text, by text, then hash."""
    hashes = words.hashes(lower=True)
    grams, _, gram_at = T.windows(hashes, words.word_at, n)
    owner = T.owners(gram_at)
    counts = np.diff(words.word_at)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):  # the whole sequence is the only n-gram
        whole = np.zeros(len(short), np.uint64)
        for j in range(n - 1):
            has = counts[short] > j
            whole[has] = T.mix(whole[has] + hashes[words.word_at[short[has]] + j] + np.uint64(j + 1))
        grams, owner = np.concatenate([grams, whole]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, owner, np.searchsorted(owner, np.arange(len(counts) + 1))


def _counted(hashes: np.ndarray, numbers: list[np.ndarray]) -> list[np.ndarray]:
    begins = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return [np.repeat(np.add.reduceat(numbers[0], begins), np.diff(np.append(begins, len(hashes))))]


def _rarest(grams: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The n-grams that recur, by count, then hash (their own order)."""
    order = np.argsort(count, kind="stable")
    return grams[order[np.searchsorted(count[order], 2) :]].view(np.int64)


def recurring(docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """A written table of all documents; shingles: those that other documents share, rarest first, null if they are too few to link.

    Rarity is the count of the first question, which is the same for an n-gram wherever it stands.
    """
    blocks = B.pack(docs, key, text)
    scale = B.scale_of(blocks)
    leading = scale.leading(SPARE)

    def ask(row: dict) -> tuple[np.ndarray, list[np.ndarray]]:
        distinct, count = np.unique(_sets(B.unpack(row)[1], n)[0] & leading, return_counts=True)
        return distinct, [count]

    def keep(row: dict) -> Iterator[pa.RecordBatch]:
        ids, words = B.unpack(row)
        grams, owner, at = _sets(words, n)
        count = B.replies_of(row, 1)[0][np.unique(grams & leading, return_inverse=True)[1]]
        size = np.diff(at)
        enough = (100 * T.per_text(count > 1, at) >= percent * size) & (size > 0)
        lists = [_rarest(grams[a:b], count[a:b]) if ok else None for a, b, ok in zip(at[:-1], at[1:], enough, strict=True)]
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (T.mix(grams + np.uint64(7)), T.mix(grams ^ np.uint64(0xABCDEF)))]
        class_, check = (T.mix(s[at[1:]] - s[at[:-1]] + size.astype(np.uint64)).view(np.int64) for s in sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(ids), row["block"])), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids, pa.int64(), mask=ids == B.NULL_ID), pa.array(size, pa.int64()), pa.array(class_), pa.array(check), pa.array(lists, pa.list_(pa.int64()))],
            ["block", "at", "doc_id", "n_shingles", "class", "check", "shingles"],
        )

    found = materialize(B.map_blocks(B.ask_and_answer(blocks, ask, _counted, scale.buckets), keep, _DOCS))
    drop(blocks)
    return found


def _classes(found: DataFrame) -> DataFrame:
    """A written table (class, n, weight, items) of distinct sets that may link; items: n-grams that recur, rarest first."""
    linking = found.where(F.col("shingles").isNotNull())
    first = materialize(linking.groupBy("class", "check").agg(F.min(F.struct("block", "at")).alias("f")).select("f.*"))
    one = linking.join(small(first, MOST_BROADCAST), ["block", "at"], "left_semi")
    return materialize(one.select("class", F.col("n_shingles").alias("n"), (1 + F.floor(F.size("shingles") / PER_CLASS)).alias("weight"), F.col("shingles").alias("items")))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The product of the sets' incidence matrix with its transpose, accumulated over ranges of n-grams; whole numbers."""
    which, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.bincount(column, minlength=len(which)) > 1
    renumbered = np.cumsum(shared) - 1
    row, column = row[shared[column]], renumbered[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for low in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        out += (part @ part.T).astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])  # also of n-grams that a set has to itself
    return out


def link_roots(sets: list[np.ndarray], n: np.ndarray, percent: int) -> np.ndarray:
    """For each set the first one of those that it reaches by links among the given sets."""
    common = overlaps(sets)
    union = n[:, None] + n[None, :] - common
    linked = 100 * common >= percent * union
    np.fill_diagonal(linked, True)
    root = np.arange(len(sets))
    while True:  # the least root of all linked, then of the root itself
        least = np.where(linked, root[None, :], len(sets)).min(1)
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _product(rows: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) from (bin, block, class, n, items): the roots of links within each block of a bin."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("class", "ascending")])
        block, name, n = (table.column(c).to_numpy() for c in ("block", "class", "n"))
        items = table.column("items").combine_chunks()
        flat, at = items.flatten().to_numpy(), np.concatenate([[0], np.cumsum(items.value_lengths().to_numpy())])
        edges = []
        cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                root = link_roots([flat[at[i] : at[i + 1]] for i in range(a, b)], n[a:b], percent)
                own = np.flatnonzero(root != np.arange(b - a))
                edges.append(np.stack([name[a + own], name[a + root[own]]]))
        both = np.concatenate(edges, 1) if edges else np.empty((2, 0), np.int64)
        return pa.table({"a": pa.array(both[0], pa.int64()), "b": pa.array(both[1], pa.int64())})

    return rows.groupBy("bin").applyInArrow(run, "a long, b long")


def links(classes: DataFrame, percent: int, tile: int = TILE, pivots: int = PIVOTS, bins: int | None = None) -> DataFrame:
    """A written table of edges (a, b) between classes whose components are those of all links."""
    least_common = F.expr(f"(n * {percent} + 99) div 100")
    prefix = F.col("n") - least_common + 1 - (F.col("n") - F.size("items"))
    entries = classes.select("class", F.explode(F.slice(F.col("items"), F.lit(1), F.greatest(prefix, F.lit(0)).cast("int"))).alias("h"))
    first = entries.groupBy("h").agg(F.min("class").alias("to"), F.count(F.lit(1)).alias("g")).where("g > 1").select(F.col("h").alias("at"), "to")
    touching = entries.join(first, F.col("h") == F.col("at")).select(F.col("class").alias("a"), F.col("to").alias("b"))
    blocks = components(touching).join(classes.select("class", "weight"), F.col("node") == F.col("class")).select("node", "weight", F.col("root").alias("block"))
    blocks = materialize(blocks)
    sizes = blocks.groupBy(F.col("block").alias("of_block")).agg(F.sum("weight").alias("k"))
    where = materialize(blocks.join(sizes, F.col("block") == F.col("of_block")).select("node", "block", "k"))
    sized = classes.join(small(where, MOST_BROADCAST), F.col("class") == F.col("node")).select("block", "k", "class", "n", "weight", "items")
    total = blocks.agg(F.sum("weight")).first()[0] or 0
    bins = bins or max(256, total // tile)
    name = lambda *parts: F.xxhash64(*parts)
    few = sized.where(F.col("k") <= tile).select(F.pmod(name("block"), F.lit(bins)).alias("bin"), "block", "class", "n", "items")
    edges = materialize(_product(few, percent))
    if where.where(F.col("k") > tile).isEmpty():
        return edges
    large = materialize(sized.where(F.col("k") > tile))
    # every class of a large block meets the block's pivots, in groups by hash
    groups = F.ceil(F.col("k") / tile)
    chosen = Window.partitionBy("block").orderBy("class")  # over the candidates for pivots only
    low = F.abs(F.xxhash64("class") % F.col("k")) < 4 * pivots
    pivot = large.where(low).withColumn("rank", F.row_number().over(chosen)).where(F.col("rank") <= pivots).drop("rank")
    met = large.withColumn("group", F.pmod(F.xxhash64("class"), groups)).union(pivot.withColumn("group", F.explode(F.sequence(F.lit(0), groups - 1))))
    met = met.dropDuplicates(["block", "class", "group"])
    star = materialize(_product(met.select(name("block", "group").alias("bin"), "block", "class", "n", "items"), percent))
    joined = components(star).withColumnRenamed("root", "label")
    # tiles by (label, size): pairs of tiles with one and the same label are done
    labelled = large.join(joined, F.col("class") == F.col("node"), "left")
    labelled = labelled.withColumns({"kin": F.coalesce("label", F.lit(-(1 << 63))), "label": F.coalesce("label", "class")}).drop("node")
    placed = materialize(_tiled(labelled, tile))
    tiles = materialize(placed.groupBy("block", "tile").agg(F.min("label").alias("from"), F.max("label").alias("upto"), F.min("n").alias("least"), F.max("n").alias("most")))
    x, y = tiles.alias("x"), tiles.alias("y")
    reach = (F.col("x.most") * 100 >= F.col("y.least") * percent) & (F.col("y.most") * 100 >= F.col("x.least") * percent)
    done = (F.col("x.from") == F.col("x.upto")) & (F.col("y.from") == F.col("y.upto")) & (F.col("x.from") == F.col("y.from"))
    todo = x.join(y, (F.col("x.block") == F.col("y.block")) & (F.col("x.tile") <= F.col("y.tile"))).where(reach & ~done)
    todo = todo.select(F.col("x.block").alias("in_block"), F.col("x.tile").alias("i"), F.col("y.tile").alias("j"))
    sides = todo.select("in_block", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("side"))
    rest = placed.join(sides, (F.col("block") == F.col("in_block")) & (F.col("tile") == F.col("side")))
    crossed = _product(rest.select(name("block", "i", "j").alias("bin"), "block", "class", "n", "items"), percent)
    return materialize(edges.union(star).union(crossed))


def _tiled(labelled: DataFrame, tile: int) -> DataFrame:
    """``labelled`` with ``tile``: successive runs of classes of a block by kin and size, of a weight of about ``tile``.

    kin is the label, and one value for all classes that have not been joined. Kin and ranges of sizes
    (a factor of 1.25, which is where links end) are counted first, so no block is sorted as a whole;
    a class's place within its range comes from a hash.
    """
    ranged = labelled.withColumn("range", F.floor(F.log(F.col("n")) / F.log(F.lit(1.25))))
    order = Window.partitionBy("of_block").orderBy("of_kin", "of_range")
    counts = (
        labelled.withColumn("range", F.floor(F.log(F.col("n")) / F.log(F.lit(1.25))))
        .groupBy(F.col("block").alias("of_block"), F.col("kin").alias("of_kin"), F.col("range").alias("of_range"))
        .agg(F.sum("weight").alias("c"))
        .withColumn("before", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    )
    same = (F.col("block") == F.col("of_block")) & (F.col("kin") == F.col("of_kin")) & (F.col("range") == F.col("of_range"))
    place = F.coalesce(F.col("before"), F.lit(0)) + F.pmod(F.xxhash64("class", F.lit(1)), F.col("c"))
    return ranged.join(counts, same).withColumn("tile", F.floor(place / tile)).drop("of_block", "of_kin", "of_range", "c", "before", "range")


def jaccard_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document.

    Words are lower-cased (A-Z); a set has the distinct ``words``-grams of a text, or its whole
    sequence if it is shorter. Two documents link when 100 * common >= percent * union; component_id
    is the smallest id that links reach. Null and empty texts have empty sets and link with nothing.
    Repeated rows are copies of each other. A null id counts as greater than all others. An empty
    table gives an empty table.
    """

    def build() -> DataFrame:
        found = recurring(docs, key, text, words, percent)
        classes = _classes(found)
        joined = components(links(classes, percent)).select(F.col("node"), F.col("root"))
        members = found.where(F.col("shingles").isNotNull()).groupBy("class", "check").agg(F.min(F.coalesce("doc_id", F.lit(B.NULL_ID))).alias("least"))
        rooted = members.join(joined, F.col("class") == F.col("node"), "left").select("class", "check", "least", F.coalesce("root", "class").alias("root"))
        least = rooted.groupBy(F.col("root").alias("of_root")).agg(F.min("least").alias("component"))
        named = rooted.join(least, F.col("root") == F.col("of_root")).select(F.col("class").alias("in_class"), F.col("check").alias("in_check"), "component")
        linking = F.col("shingles").isNotNull()
        rest = found.where(~linking).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        grouped = found.where(linking).join(named, (F.col("class") == F.col("in_class")) & (F.col("check") == F.col("in_check")))
        return grouped.select("doc_id", "n_shingles", F.nullif(F.col("component"), F.lit(B.NULL_ID)).alias("component_id")).union(rest)

    return settle(docs.sparkSession, build)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM c JOIN n nx ON c.x = nx.doc_id JOIN n ny ON c.y = ny.doc_id WHERE 100 * common >= 80 * (nx.n + ny.n - common)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(r.y), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN r ON w.doc_id = r.x GROUP BY w.doc_id
"""
