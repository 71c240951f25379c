"""Quality classifier, token alignment and hard negatives against plain Python and held-out labels."""

import collections
import math

import numpy as np
import pyarrow as pa
import pytest
from compare import DATA, check
from pyspark.sql import functions as F

from tessera.llm import align, negatives, subwords

ODD = [None, "", " ", "   ", "  two  spaces ", "tab\tand\n\n line \n", "one", "x" * 3000, "é ﬁ 　x ß", "▁mark", "in▁side", " " * 5000 + "end", "\n" * 3000, "<|endoftext|> <s></s> <unk><0x41>", "\0a \0", "😀 \U0010ffff z", "don't \"x\" 1234567", "end \n"]


def words_by_hand(text):
    """(a ids, b ids, groups of positions) of a text by the tokenizers' libraries and one pass over their ends."""
    own = align.aligner(align.A_PATH, align.B_PATH)
    if not text:
        return [], [], []
    a, b = own.plain.encode(" " + text, add_special_tokens=False).ids, own.pieces.encode(text)
    bytes_a, bytes_b = ([v.entries[i] for i in ids] for v, ids in ((own.a, a), (own.b, b)))
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], []
    ends = [np.cumsum([len(x) for x in xs]).tolist() for xs in (bytes_a, bytes_b)]
    groups, i, j = [], 0, 0
    for e in sorted(set(ends[0]) & set(ends[1])):
        i2, j2 = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
        groups.append((a[i:i2], b[j:j2]))
        i, j = i2, j2
    return a, b, groups


def aligned_by_hand(texts):
    found = [words_by_hand(t) for t in texts]
    counts = collections.Counter((x[-1], y[-1]) for _, _, groups in found for x, y in groups)
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for a, b, groups in found:
        links = [(x[-1], y[-1]) for x, y in groups]
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield told, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links)


def test_alignment_of_odd_and_repeated_texts(spark):
    texts = [*ODD, "the same the same", "the same the same", *[f"word{i} und ähnlich {i * i}." for i in range(40)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("groups", F.lit("mine")).withColumn("links", F.lit("mine")).repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in align.align(docs).select("doc_id", "groups", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum").collect()}
    for k, want in enumerate(aligned_by_hand(texts)):
        assert got[k] == want, texts[k]
    assert align.align(docs.limit(0)).count() == 0


def test_op12_equals_plain_alignment(spark):
    import hashlib

    sf = str(DATA / "sf0.001")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in align.op12_token_alignment(spark, sf).collect()}
    assert len(got) == len(docs)
    for k, want in zip(docs, aligned_by_hand(docs.values()), strict=True):
        r = got[k]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) == want[1:]
        assert r["groups_sha256"] == (hashlib.sha256(want[0].encode()).hexdigest() if want[0] else "")


def test_whole_texts_align_as_their_words_do():
    """What the words' shortcut gives equals whole texts, also after the worker forgot its words."""
    own = align.aligner(align.A_PATH, align.B_PATH)
    texts = [*ODD, "a b  c\td e f g\x1ch  i", "one two\n three \n\n four"]
    by_word = [x.to_pylist() for x in own.align(texts)]
    own.forget()
    own.by_word = False
    try:
        assert [x.to_pylist() for x in own.align(texts)] == by_word
    finally:
        own.by_word = True
        own.forget()


def test_counts_are_for_all_links(spark):
    blobs = spark.createDataFrame([(b"",), (None,)], "links binary")
    assert align.link_counts(blobs).count() == 0
    assert [tuple(r) for r in align.judged(blobs).select("n_best", "count_sum").collect()] == [(0, 0), (0, 0)]


def test_op13_equals_sql(spark):
    check(spark, negatives.op13_hard_negatives, negatives.ORACLE_SQL)


def mined_by_hand(rows, anchors, positives=5, negatives_=5):
    whole = sorted({(i, lab, tuple(math.floor(x * 256) if abs(x) < 1e300 else int(x) * 256 for x in v)) for i, lab, v in rows}, key=str)
    clamp = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    out = []
    for i, lab, v in whole:
        if i not in anchors:
            continue
        scored = [(-clamp(sum(a * b for a, b in zip(v, w, strict=True))), j, other) for j, other, w in whole if j != i]
        for s, p, _ in sorted(x for x in scored if x[2] == lab)[:positives]:
            hard = sorted(x for x in scored if x[2] != lab and 80 * -s <= 100 * -x[0] <= 100 * -s)[:negatives_]
            out += [(i, p, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e-40, 3e16, 1e34, 1e200])
def test_hard_negatives_of_any_size(spark, scale):
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(0, 4)), (scale * rng.standard_normal(5).round(2)).tolist()) for i in range(120)]
    rows += [(i, 1, (scale * np.ones(5)).tolist()) for i in range(200, 240)] + [rows[3], (7, 2, [0.0] * 5)]
    odd = [(300, None, [1.0] * 5), (301, 1, None), (302, 1, [1.0, None, 0.0, 0.0, 0.0]), (303, 1, [math.nan] * 5), (304, 1, [math.inf] * 5), (305, 1, [1.0]), (None, 1, [1.0] * 5)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<double>").withColumn("anchor", F.lit("mine")).withColumn("rank", F.lit(1))
    got = negatives.mine(frame, F.col("vec_id") % 20 == 0, row_block=50, anchor_block=3)
    want = mined_by_hand(rows, {i for i, *_ in rows if i % 20 == 0})
    assert sorted(map(tuple, got.collect())) == want and (scale != 1.0 or want)
    assert negatives.mine(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert negatives.mine(frame, F.lit(False)).count() == 0


def test_brackets_hold_every_score():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8)) * 3
    unit = float(np.abs(np.floor(x * 256)).max())
    most = float((np.floor(x * 256) ** 2).sum(1).max()) / unit**2
    space = negatives.Space(8, unit, most, np.zeros((0, 9)))
    space = negatives.Space(8, unit, most, negatives.pick(x[:100], space, 6))
    far, own = space.distances(x, False), space.distances(x[:5], True)
    for k in range(5):
        least, largest = space.bracket(far, own[k], float((space.scaled(x[k : k + 1]) ** 2).sum()))
        score = np.floor(x * 256) @ np.floor(x[k] * 256)
        assert (least <= score).all() and (score <= largest).all() and (largest - least).mean() < np.abs(score).max() * 20


def test_op11_on_held_out_labels(spark):
    sf = str(DATA / "sf0.1")
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = subwords.op11_quality_classifier(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    tested = [(quality[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in quality]
    for kind in (0, 1):
        own = [p == q for q, p in tested if q == kind]
        assert len(own) > 50 and sum(own) / len(own) >= 0.97


def test_scores_hang_on_the_text_alone(spark):
    good, bad = "plain words that go on and on", "%%% ### $$$ junk%%% junk###"
    docs = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(40)] + [(50, None), (51, ""), (52, good), (52, good), (None, bad), (53, "ab " * 1_000_000)], "doc_id long, text string").withColumn("class_scores", F.lit("mine"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (4, 0), (99, 1)], "doc_id long, quality int")
    model = subwords.learn(labels, docs, "doc_id", "quality")
    got = subwords.classify(docs, model).collect()
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[r["text"] or ""].add(tuple(r["class_scores"]))
    assert len(got) == 46 and all(len(v) == 1 for v in by_text.values()) and model.classes == [0, 1]
    assert by_text[good].pop()[1] > 0.9 and by_text[bad].pop()[1] < 0.1
    assert subwords.learn(labels.limit(0), docs, "doc_id", "quality") is None and subwords.learn(labels, docs.limit(0), "doc_id", "quality") is None
    assert [r["class_scores"] for r in subwords.classify(docs.limit(1), None).collect()] == [[]]
    assert subwords.classify(docs.limit(0), model).count() == 0


def test_a_text_in_pieces_scores_as_a_whole():
    worth = np.random.default_rng(1).standard_normal((1026, 2)).astype(np.float32)
    texts = pa.array([" ".join(f"wörd{i % 7} wörd{i % 7} x{i}" for i in range(4000)), None, "a a b", "ß" * 9000])
    whole = subwords.odds_of(worth, texts)
    assert np.allclose(whole, subwords.odds_of(worth, texts, 500), atol=1e-9)
    for k, t in enumerate(texts.to_pylist()):
        place, n = subwords.bags([t], 1024)[0]
        assert np.allclose(whole[k], (n @ worth[place].astype(np.float64)) / n.sum(), atol=1e-6)
