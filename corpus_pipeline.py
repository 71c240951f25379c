"""The corpus pipeline: quality rules, near duplicates, secrets, mixing, tokens.

Each stage works on all documents that the one before kept, written and read again between them.
All stages but the last return the columns of ``documents``; other columns of the input stay too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, jaccard, mixing, quality, secrets
from tessera.llm.common import WORD, materialize, settle, table


def _boxed(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns that an operator needs beside the whole document, so that no name of a document's own columns clashes."""
    return docs.select(F.struct("*").alias("document"), *columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject, null and empty texts among them; repeated rows stay or go together.

    An empty table stays empty. Columns of any name stay: the operator sees the three that it needs beside the whole document.
    """
    return quality.judge(_boxed(docs, "text", "lang", "source"), keep_text=False).where("kept").select("document.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near duplicates, by its text's hash where an id has several.

    Rows that repeat an id are judged by their own text; of rows that repeat id and text one stays. Of
    the documents without an id in a group one stays as well. Those without words link with nothing.
    An empty table stays empty, and columns of any name stay.
    """
    row = F.xxhash64("doc_id", "text")

    def build() -> DataFrame:
        groups = jaccard.jaccard_groups(docs.select(row.alias("near_row"), "text"), key="near_row").select(F.col("doc_id").alias("in_row"), "component_id").distinct()
        rows = docs.select(row.alias("near_row"), "doc_id").distinct()
        first = F.min(F.struct("doc_id", "near_row")).alias("first")
        return rows.join(groups, F.col("near_row") == F.col("in_row")).groupBy("component_id", F.col("doc_id").isNull()).agg(first).select(F.col("first.near_row").alias("stays"))

    stays = settle(spark, build)  # a number for each document that stays; no more than that is kept of the join
    apart = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    boxed = docs.where(~apart).select(F.struct("*").alias("document"), row.alias("near_row"))
    return boxed.join(stays, F.col("near_row") == F.col("stays"), "left_semi").dropDuplicates(["near_row"]).select("document.*").union(docs.where(apart))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of a secret in its place; n_chars follows where there is one. A null or empty text stays; repeated rows are cut alike.

    An empty table stays empty. Columns of any name stay as they are, but for text and n_chars.
    """
    cut = secrets.redact(secrets.find_secrets(_boxed(docs, "doc_id", "text", "source")))
    document = F.col("document").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        document = document.withField("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("document.n_chars")))
    return cut.select(document.alias("document")).select("document.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it. Sizes and keys are dealt by source, documents stay where they are.

    Null and empty texts have no words and are never taken. A null source is one of its own. Repeated
    rows share their draws and are taken alike, as far as the last budget goes. An empty table stays
    empty, and columns of any name stay.
    """
    sizes = mixing.with_draws(docs.select("doc_id", "text", "source")).select("source", "size", "weight", "draw")
    cuts = mixing.cutoffs(mixing.mix_sources(materialize(sizes)))
    drawn = mixing.with_draws(_boxed(docs, "doc_id", "text", "source")).drop("text")
    mixed = mixing.take(drawn, cuts).where("mix_copies > 0")
    return mixed.select("document", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select("document.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids) of every document of the mix, and whether decoding gives the text again.

    A null or empty text has no ids; repeated rows are encoded each. Other columns end here.
    """
    encoded = docs.select("doc_id", "source", "text", bpe.round_trip(F.col("text")).alias("z"))
    same = F.sha2(F.col("z.decoded"), 256) == F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return encoded.select("doc_id", "source", F.size("z.ids").cast("long").alias("n_tokens"), "z.ids", same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_quality),
    ("jaccard_join", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix),
    ("byte_bpe", tokenize),
]

#: SQL can't express the tokenizer's merges over the 50,000 ranks of a file that is no table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
