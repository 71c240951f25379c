"""Secret scans whose verdict on a candidate hangs on who owns it in the whole corpus.

A scan finds assignments to telling names, access keys, long hexadecimal runs and, as candidates
only, other long tokens of mixed letters and digits. Hashes of all of them are aggregated by
distinct repositories and owners. A value that many owners share in many repositories is a copied
example; one that keeps to few owners looks like a live credential, however many of their
repositories hold it: that number grows with the corpus and with copies of one document. So does one
that few repositories hold, of whichever owners. Candidates of the latter kinds become spans too.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tessera.llm import text as T
from tessera.llm.common import bound_batches, materialize, settle, table

#: Kinds of spans in their order; the last is the one that needs the corpus.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX, LEAST_TOKEN = 12, 18, 16, 20
#: A value is widely copied if more owners and more repositories hold it; all others look live.
MOST_OWNERS, MOST_REPOSITORIES = 2, 3

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_FOUND = ArrayType(StructType([StructField("kind", IntegerType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("value", LongType())]))
_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64())]))


def value_hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def _runs(data: np.ndarray, at: np.ndarray, allowed: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(text, start, end) in bytes of the longest runs of allowed bytes, inside one text, of ``least`` or more."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = allowed[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    before = np.concatenate([[False], inside[:-1]])
    starts, ends = np.flatnonzero(inside & (~before | first)), np.flatnonzero(before & (~inside | first))
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    return list(zip((np.searchsorted(at, starts, "right") - 1).tolist(), starts.tolist(), ends.tolist(), strict=True))


def scan_texts(texts: pa.Array) -> list[list[dict]]:
    """The findings of each text, spans in code points: base kinds, then (kind 3) tokens that touch none of them."""
    out: list[list[dict]] = []
    for w in T.in_pieces(texts):
        data, at = w.data, w.text_at
        whole = data.tobytes()
        found: list[list[dict]] = [[] for _ in range(len(at) - 1)]
        point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        place = lambda k, byte: int(point[byte] - point[at[k]])

        def add(k: int, kind: int, start: int, end: int, value: str, found=found) -> None:
            found[k].append({"kind": kind, "start": start, "end": end, "value": value_hash(value)})

        marks = T.per_text((data == 58) | (data == 61), at)  # an assignment has a : or a =
        for k in np.flatnonzero(marks).tolist():
            for m in ASSIGN.finditer(whole[at[k] : at[k + 1]].decode()):
                if len(m[2]) >= LEAST_VALUE:
                    add(k, 0, m.start(), m.end(), m[2])
        if b"AKIA" in whole:
            for k in range(len(at) - 1):
                if b"AKIA" in (one := whole[at[k] : at[k + 1]]):
                    for m in ACCESS.finditer(one.decode()):
                        if len(m[0]) >= LEAST_ACCESS:
                            add(k, 1, m.start(), m.end(), m[0])
        for k, a, b in _runs(data, at, _HEX, LEAST_HEX):
            add(k, 2, place(k, a), place(k, b), whole[a:b].decode())
        reach: dict[int, tuple[list[int], list[int]]] = {}
        for k, a, b in _runs(data, at, _TOKEN, LEAST_TOKEN):
            value = whole[a:b].decode()
            if re.search("[0-9]", value) and re.search("[A-Za-z]", value) and len(set(value)) >= 8:
                start, end = place(k, a), place(k, b)
                if k not in reach:  # by start, how far the base findings reach
                    spans = sorted((x["start"], x["end"]) for x in found[k])
                    reach[k] = [s for s, _ in spans], list(itertools.accumulate((e for _, e in spans), max))
                starts, ends = reach[k]
                before = bisect.bisect_left(starts, end)
                if not (before and ends[before - 1] > start):
                    add(k, 3, start, end, value)
        out += found
    return out


@F.arrow_udf(_FOUND)
def _scan(texts: pa.Array) -> pa.Array:
    return pa.array(scan_texts(texts), _SPAN)


@F.arrow_udf(StringType())
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        if text and own:
            parts, at = [], 0
            for s in sorted(own, key=lambda s: (s["start"], s["kind"])):
                if s["start"] >= at:
                    parts += [text[at : s["start"]], f"[{KINDS[s['kind']]}]"]
                at = max(at, s["end"])
            text = "".join([*parts, text[at:]])
        out.append(text)
    return pa.array(out, pa.string())


def redact(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Puts ``[kind]`` in the place of every span (of spans that overlap, one for all).

    A null text, and one without spans, stays as it is; null spans are none. Repeated rows are cut alike,
    an empty table stays empty, and no other column is touched.
    """
    return docs.withColumn(text, _cut(F.col(text), F.col(spans)))


def find_secrets(docs: DataFrame, text: str = "text", repository: str = "doc_id", owner: str = "source", keep_text: bool = True, most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """``docs`` with ``base_spans``, ``spans`` (both by start, then kind) and ``n_copied``.

    A span is (start, kind, end) in code points, end exclusive, kind an index into ``KINDS``; n_copied
    counts the base spans whose value is too widely held to look live. A null text counts as empty,
    a null owner or repository as one of its own. Repeated rows get the same spans. A very long text is
    scanned whole, in time about in proportion to it. An empty table gives an empty table. Other columns stay, but for those named as a result or ``secret_*``.

    ``docs`` is read twice, once for the scan, whose findings are written, and once to meet them.
    """
    docs = docs.drop("base_spans", "spans", "n_copied", *[c for c in docs.columns if c.lower().startswith("secret_")])
    keyed = docs.withColumn("secret_text", F.xxhash64(F.col(text)))
    bound_batches(docs.sparkSession)

    def build() -> DataFrame:
        scanned = keyed.select(F.col(repository).alias("secret_r"), F.col("secret_text").alias("secret_t"), F.col(owner).alias("o"), _scan.asNondeterministic()(F.col(text)).alias("found"))
        # the scan is not to be moved into the filter and then run again for its column
        found = materialize(scanned.where(F.size("found") > 0))  # the few documents with findings, without their texts
        held = found.select("secret_r", "secret_t", "o", F.explode("found").alias("f")).select("secret_r", "secret_t", "o", "f.*")
        # one row for each repository, then for each owner, then for each value: nothing gathers in one group
        in_repository = held.groupBy("value", "o", "secret_r").agg(F.lit(1).alias("one"))
        of_owner = in_repository.groupBy("value", "o").agg(F.count(F.lit(1)).alias("repositories"))
        holders = of_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
        live = holders.where((F.col("owners") <= most_owners) | (F.col("repositories") <= most_repositories)).select(F.col("value").alias("live"))
        judged = held.join(live, F.col("value") == F.col("live"), "left").select("secret_r", "secret_t", F.struct("start", "kind", "end").alias("s"), F.col("live").isNotNull().alias("live"))
        base, owned = F.col("s.kind") < 3, F.col("live")
        return judged.groupBy("secret_r", "secret_t").agg(
            F.array_sort(F.collect_set(F.when(base, F.col("s")))).alias("secret_base"),
            F.array_sort(F.collect_set(F.when(base | owned, F.col("s")))).alias("secret_all"),
            F.array_sort(F.collect_set(F.when(base & ~owned, F.col("s")))).alias("secret_copied"),
        )

    of_text = settle(docs.sparkSession, build)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    out = keyed.join(of_text, F.col(repository).eqNullSafe(F.col("secret_r")) & (F.col("secret_text") == F.col("secret_t")), "left").withColumns(
        {"base_spans": F.coalesce("secret_base", none), "spans": F.coalesce("secret_all", none), "n_copied": F.coalesce(F.size("secret_copied"), F.lit(0)).cast("long")}
    )
    return out.drop("secret_text", "secret_r", "secret_t", "secret_base", "secret_all", "secret_copied", *([] if keep_text else [text]))


def listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False)
    count = lambda k: F.size(F.filter("base_spans", lambda s: s.kind == k)).cast("long")
    return docs.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(listed(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        "n_copied",
    )
