"""Inputs on which an operator once left out a part of its job."""

import random
import time

import corpus_pipeline
import numpy as np
import pyarrow as pa

from tessera.llm import forest, langid, secrets


def test_values_of_one_owner_stay_spans_in_many_documents(spark):
    mine, copied, common = "Zq8Xw3Lm5Vt7Rk2Pn9Ys4", "Hb5Gd7Jf9Kl1Mn3Pq5Rs7", "Ab1Cd2Ef3Gh4Ij5Kl6Mn7"
    rows = [(i, f"number {i} has {mine}", "me") for i in range(30)] + [(100 + i, f"same {copied}", "me") for i in range(30)]
    rows += [(200 + i, f"number {i} has {common}", f"o{i % 3}") for i in range(30)] + [(300 + i, f"password = abcdefghijkl{i // 20}", f"o{i % 3 if i < 20 else 0}") for i in range(40)]
    got = {r["doc_id"]: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [len(got[d]["spans"]) for d, *_ in rows] == [1] * 60 + [0] * 30 + [1] * 40
    assert [got[300 + i]["n_copied"] for i in range(40)] == [1] * 20 + [0] * 20


def nearest(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return [r["vec_id"] for r in forest.nearest(frame, frame.where("vec_id = 0"), k=5, share=24.0, **options).orderBy("rank").collect()]


def test_ties_of_many_vectors_go_to_the_smaller_ids(spark):
    ids = list(range(1, 513))
    random.Random(3).shuffle(ids)
    tied = [(d, [1.0] + [float(b >> i & 1) for i in range(9)]) for b, d in enumerate(ids)]
    assert nearest(spark, [(0, [0.5] + [0.0] * 9), *tied]) == [1, 2, 3, 4, 5]


def test_one_longer_vector_changes_nothing(spark):
    rows = [(i, [1.0, float(i), 2.0]) for i in range(9)]
    assert nearest(spark, [*rows, (50, [9.0] * 4)]) == nearest(spark, rows) == [1, 2, 3, 4, 5]


def test_near_duplicates_are_judged_by_row(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(80)) for x in "abcd")
    rows = [(1, a), (1, a), (3, a + " end"), (1, b), (2, b), (0, d), (1, d), (None, c), (None, c + " end"), (None, None), (None, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    found = [(r["doc_id"], (r["text"] or "")[:1]) for r in got.collect()]
    assert got.columns == docs.columns and sorted(found, key=str) == sorted([(1, "a"), (1, "b"), (0, "d"), (None, "c"), (None, ""), (None, ""), (4, "")], key=str)


def learned(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    model = langid.learn(labelled, "text", "lang", "doc_id", langid.PER_LANGUAGE, langid.PER_CALIBRATION, langid.MOST_LANGUAGES)
    return {r["text"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}


def test_every_labelled_language_is_learned(spark):
    english, german = "the quick brown fox jumps over the lazy dog", "der schnelle braune Fuchs springt über den faulen Hund"
    for i in (0, 1, 2, 13, 28):
        assert learned(spark, [(i, english, "en"), (99, "???", None)]) == {english: "en", "???": "und"}
    many = [(i, f"{english} {i}", "en") for i in range(1, 34)]
    assert learned(spark, [*many, (0, german, "de")])[german] == "de"
    nameless = [(None, f"{english} {'again ' * i}", "en") for i in range(150)] + [(None, german, "de")]
    assert learned(spark, nameless)[german] == "de"


def test_large_and_small_components_find_their_neighbours(spark):
    rng = np.random.default_rng(6)
    for scale in (1e36, 1e-40, 1e34):
        rows = [(i, (scale * rng.standard_normal(8)).astype(np.float32).tolist()) for i in range(300)]
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        got = {}
        for r in forest.nearest(frame, frame.where("vec_id % 20 = 0"), k=5, share=24.0).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        x = np.array([v for _, v in rows], float)
        score = x @ x.T
        np.fill_diagonal(score, -np.inf)
        assert got == {q: sorted(range(300), key=lambda i, q=q: (-score[q, i], i))[:5] for q in range(0, 300, 20)}


def test_repositories_and_owners_make_the_verdict(spark):
    three, four = "Aa1Bb2Cc3Dd4Ee5Ff6Gg7", "Hh1Ii2Jj3Kk4Ll5Mm6Nn7"
    rows = [(i, f"n {three}", f"o{i}") for i in range(3)] + [(10 + i, f"n {four}", f"o{i % 3}") for i in range(4)]
    got = {r["doc_id"]: len(r["spans"]) for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [got[d] for d, *_ in rows] == [1] * 3 + [0] * 4


def test_texts_of_many_tokens_are_quick():
    rng = random.Random(1)
    token = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789ABCDEF", k=24))
    text = " ".join(f"password={token()} {token()}" if i % 3 else token() for i in range(40_000))
    began = time.perf_counter()
    found = secrets.scan_texts(pa.array([text]))[0]
    assert len(found) > 60_000 and time.perf_counter() - began < 20
    spans = sorted((x["start"], x["end"]) for x in found if x["kind"] != 2)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
