import collections
import math

import corpus_pipeline
import numpy as np
import pytest
from compare import DATA
from library import library
from pyspark.sql import functions as F

from tessera.llm import forest, jaccard, mixing, quality, secrets
from tessera.llm.components import components


def brute(vectors, queries, k):
    out = {}
    for q, v in queries.items():
        scored = sorted((-float(np.dot(v, x)), i) for i, x in vectors.items() if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_op5_recall(spark):
    sf = str(DATA / "sf0.1")
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    want = brute(vectors, {i: v for i, v in vectors.items() if i % 20 == 0}, 20)
    got = collections.defaultdict(list)
    for r in forest.op5_nearest_vectors(spark, sf).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["score"] == pytest.approx(float(np.dot(vectors[r["query_id"]], vectors[r["vec_id"]])), abs=1e-12)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / 20 / len(want) >= 0.9


def test_nearest_with_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(6).round(3).tolist()) for i in range(40)] + [(i, [1.0, 0.0, 2.0, 0.0, 0.0, 1.0]) for i in range(100, 160)]
    odd = [(200, None), (201, [0.0] * 6), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [math.nan] + [1.0] * 5), (204, [math.inf] + [1.0] * 5), (205, [1.0]), (None, [1.0] * 6), (3, rows[3][1])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("tree", F.lit("mine"))
    want = brute({i: np.array(v) for i, v in rows}, {i: np.array(v) for i, v in rows if i % 20 == 0}, 5)
    got = collections.defaultdict(list)
    for r in forest.nearest(frame, frame.where("vec_id % 20 = 0"), k=5, share=24.0, cell_rows=16, cell_queries=1).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert dict(got) == {q: [i for i, _ in v] for q, v in want.items()}
    assert forest.nearest(frame.limit(0), frame.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 15)] + [(50, 50), (60, 61), (61, 60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100 + i: 100 for i in range(15)} | {60: 60, 61: 60}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_equals_its_stages_by_hand(spark):
    """Each stage against the plain result of its operator on what the stage before kept."""
    sf = str(DATA / "sf0.001")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, sf)
    verdict = {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert set(rows) == {d for d, k in verdict.items() if k} and kept.columns == docs.columns
    one = corpus_pipeline.drop_near_duplicates(spark, kept, sf)
    groups = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_groups(kept).collect()}
    assert {r["doc_id"] for r in one.collect()} == set(groups.values()) and one.columns == docs.columns
    cut = corpus_pipeline.redact_secrets(spark, one, sf).collect()
    spans = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(one).collect()}
    for r in cut:
        before = rows[r["doc_id"]]["text"]
        assert (r["text"] == before) == (not spans[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    mixed = corpus_pipeline.mix(spark, spark.createDataFrame(cut, docs.schema), sf)
    copies = {r["doc_id"]: r["mix_copies"] for r in mixing.mix_sources(mixing.with_draws(spark.createDataFrame(cut, docs.schema))).collect()}
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == {d: n for d, n in copies.items() if n}
    texts = {r["doc_id"]: r["text"] for r in cut}
    final = corpus_pipeline.run(spark, sf).collect()
    assert all(r["round_trip"] and r["ids"] == library().encode_ordinary(texts[r["doc_id"]]) for r in final)
    assert collections.Counter(r["doc_id"] for r in final) == {d: n for d, n in copies.items() if n}


def test_pipeline_of_odd_rows(spark):
    words = " ".join(f"word{i}" for i in range(80))
    rows = [(None, words, "en", "s", 1), (None, None, None, None, None), (1, words, "en", "s", 1), (1, words, "en", "s", 1), (2, words + " end", "en", None, 1), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("mine")).withColumn("spans", F.lit("mine"))
    for frame, size in ((docs, 2), (docs.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, "")
            assert frame.columns == docs.columns, name
            if name == "jaccard_join":
                assert sorted(str(r["doc_id"]) for r in frame.collect()) == ["1", "None"][:size]
        assert corpus_pipeline.tokenize(spark, frame, "").count() >= 0
