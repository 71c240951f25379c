"""Operators on texts against brute force, with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import regex
from compare import DATA, check
from hypothesis import given, settings
from hypothesis import strategies as st
from library import library
from pyspark.sql import functions as F

from tessera.llm import bpe, jaccard, langid, quality, scoring, secrets, substrings
from tessera.llm import text as T

LONG = " ".join(f"w{i % 997}" for i in range(30_000))
ODD = [None, "", " \t\n", "a", "A  b", "a b", "one two three four five six", LONG, LONG, "x" * 4000, "é" * 50 + " ß", "\x00\x1f", "日本 語"]


def odd_docs(spark, **extra):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "one two three four five six"), (3, "a"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "if(doc_id % 2 = 0, 's', null) AS source")
    return docs.selectExpr("*", *[f"'{v}' AS `{k}`" for k, v in extra.items()]).repartition(3)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab A\n\t é", max_size=30), max_size=6), st.integers(1, 4))
def test_words_and_windows(texts, n):
    w = list(T.in_pieces(pa.array(texts, pa.string()), 16))
    got, grams = [], []
    for piece in w:
        h = piece.hashes(lower=True)
        g, at, gram_at = T.windows(h, piece.word_at, n)
        for k in range(len(piece.text_at) - 1):
            a, b = piece.word_at[k], piece.word_at[k + 1]
            got.append([piece.data[i:j].tobytes() for i, j in zip(piece.starts[a:b], piece.ends[a:b], strict=True)])
            assert at[gram_at[k] : gram_at[k + 1]].tolist() == list(range(a, max(a, b - n + 1)))
            grams += list(zip([tuple(x.lower() for x in got[-1][i : i + n]) for i in range(max(0, len(got[-1]) - n + 1))], g[gram_at[k] : gram_at[k + 1]].tolist(), strict=True))
    assert got == [t.encode().split() for t in texts]
    assert len({x for x, _ in grams}) == len({y for _, y in grams}) == len(set(grams))


# --- quality rules


def test_op4_equals_sql(spark):
    check(spark, quality.op4_quality_rules, quality.ORACLE_SQL, "sf0.01")


def test_quality_of_odd_rows(spark):
    got = quality.judge(odd_docs(spark, kept="mine", N_WORDS="mine", fence_upper="x")).collect()
    assert len(got) == len(ODD) + 3 and not any(r["kept"] for r in got if not (r["text"] or "").split())
    assert {r["n_words"] for r in got if r["text"] == LONG} == {30_000}
    assert quality.judge(odd_docs(spark).limit(0)).count() == 0


# --- secrets


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in secrets.ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in regex.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


SECRETS = ['é PASSWORD = "abcdefghijkl" x', "secret:abc token = 0123456789abcdef0123", "AKIA" + "B" * 20 + " AKIAshort", "ſecret=abcdefghijklmn", "api_key='abc.def-ghi_jkl' deadbeefdeadbeefdeadbeef"]


def test_base_spans_equal_brute_force(spark):
    texts = SECRETS + [t for t in ODD if t] + [r["text"] for r in spark.read.parquet(str(DATA / "sf0.001/documents.parquet")).select("text").collect()]
    got = [sorted((x["start"], x["kind"], x["end"]) for x in found if x["kind"] < 3) for found in secrets.scan_texts(pa.array(texts))]
    assert got == [base_spans(t) for t in texts]


def test_ownership_decides_on_candidates(spark):
    mine, common = "Zq8Xw3Lm5Vt7Rk2Pn9Ys4", "Ab1Cd2Ef3Gh4Ij5Kl6Mn7"
    rows = [(1, f"é use {mine} here", "me")] + [(i, f"copy {common} now", f"o{i}") for i in range(2, 8)] + [(20, None, None), (20, SECRETS[0], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("source", "owner")
    got = secrets.redact(secrets.find_secrets(docs, owner="owner")).collect()
    assert {r["doc_id"]: r["text"] for r in got if r["doc_id"] < 8} == {1: "é use [owned] here"} | {i: f"copy {common} now" for i in range(2, 8)}
    assert sorted(r["text"] or "" for r in got if r["doc_id"] == 20) == ["", 'é [assign]" x']


def test_ownership_on_a_whole_table_equals_brute_force(spark):
    rng = random.Random(6)
    values = ["".join(rng.choice("abcdefGHIJKLMNOP0123456789_-") for _ in range(24)) for _ in range(40)]
    planted = [(-1 - i, f"see {rng.choice(values)} and {rng.choice(values)} é {rng.choice(values)}", rng.choice(["s1", "s2", "s3", "s4", None])) for i in range(60)]
    frame = spark.read.parquet(str(DATA / "sf0.01/documents.parquet")).select("doc_id", "text", "source").union(spark.createDataFrame(planted, "doc_id long, text string, source string"))
    docs = frame.collect()
    found, owners, repositories = {}, collections.defaultdict(set), collections.defaultdict(set)
    for r in docs:
        text = r["text"] or ""
        spans = [(0, m.start(), m.end(), m[2]) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 12]
        spans += [(1, m.start(), m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [(2, m.start(), m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
            v = m[0]
            mixed = len(v) >= 20 and any(c in "0123456789" for c in v) and any(c.isalpha() for c in v) and len(set(v)) >= 8
            if mixed and not any(a < m.end() and m.start() < b for _, a, b, _ in spans):
                spans.append((3, m.start(), m.end(), v))
        found[r["doc_id"]] = spans
        for *_, v in spans:
            owners[v].add(r["source"])
            repositories[v].add((r["source"], r["doc_id"]))
    copied = {v for v in owners if len(owners[v]) > secrets.MOST_OWNERS and len(repositories[v]) > secrets.MOST_REPOSITORIES}
    assert {v in copied for spans in found.values() for k, *_, v in spans if k == 3} == {True, False}
    got = {r["doc_id"]: r for r in secrets.find_secrets(frame).collect()}
    for d, spans in found.items():
        kept = sorted((a, k, b) for k, a, b, v in spans if k < 3 or v not in copied)
        base = sorted((a, k, b) for k, a, b, _ in spans if k < 3)
        assert ([tuple(s) for s in got[d]["spans"]], [tuple(s) for s in got[d]["base_spans"]]) == (kept, base)
        assert got[d]["n_copied"] == sum(k < 3 and v in copied for k, _, _, v in spans)


def test_fences_of_language_and_source_decide(spark):
    """Groups of different habits: what is common in one is beyond the fence of another."""
    rng = random.Random(5)
    rows = []
    for lang, source, rate in (("en", "code", 0.6), ("en", "prose", 0.0), ("fr", "prose", 0.02)):
        for i in range(1200):
            words = [f"{lang}{rng.randrange(10**6)}" for _ in range(80)]
            marks = round(80 * rate) + (i == 0) * (10 if source == "code" else 40)
            rows.append((len(rows), " ".join(words) + " " + "#" * marks, lang, source))
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {d for d, r in got.items() if not r["kept"]} == {1200, 2400}
    wide = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), prior_rows=10**9).where("kept").count()
    assert wide == len(rows)


def test_secrets_of_odd_rows(spark):
    assert secrets.find_secrets(odd_docs(spark, spans="mine", secret_text="x")).count() == len(ODD) + 3
    assert secrets.find_secrets(odd_docs(spark).limit(0)).count() == 0


# --- tokens


def own():
    return bpe.tokenizer(bpe.RANKS, bpe.PATTERN)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="ab th'sé1 \n", max_size=60)), max_size=5))
def test_tokens_equal_the_library_and_come_back(texts):
    ids = own().encode(texts)
    assert ids.to_pylist() == [library().encode_ordinary(t) for t in texts]
    assert own().decode(ids) == [t.encode() for t in texts]


def test_words_of_one_hash_stay_apart(monkeypatch):
    fresh = bpe.Tokenizer(bpe.RANKS, bpe.PATTERN)
    monkeypatch.setattr(bpe, "hash", len, raising=False)
    for texts in (["the cat", "a dog"], ["one owl"], ["six hens and two", "the cat"]):
        assert fresh.encode(texts).to_pylist() == [library().encode_ordinary(t) for t in texts]


def test_words_are_dropped_and_learned_again(monkeypatch):
    fresh = bpe.Tokenizer(bpe.RANKS, bpe.PATTERN)
    monkeypatch.setattr(bpe, "MOST_KEPT", 40)
    rng = random.Random(8)
    for _ in range(30):
        texts = [" ".join(rng.choice(["often", "always", f"word{rng.randrange(10**4)}"]) for _ in range(20)) for _ in range(3)]
        assert fresh.encode(texts).to_pylist() == [library().encode_ordinary(t) for t in texts]
        assert len(fresh.known) < 200


def test_long_words_and_narrow_pattern():
    rng = random.Random(1)
    words = ["a" * 3000, " " * 3000, "".join(rng.choice("etaoin") for _ in range(2000))]
    assert own().encode(words).to_pylist() == [library().encode_ordinary(w) for w in words]
    chars = [chr(i) for i in range(256)] + list(" ' s ve ll 12")
    for _ in range(3000):
        t = "".join(rng.choice(chars) for _ in range(12))
        assert own().narrow.findall(t) == own().pattern.findall(t)


def test_bpe_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = docs.withColumn("ids", bpe.encode(F.col("text"))).withColumn("back", bpe.decode(F.col("ids"))).collect()
    assert all(bytes(r["back"]) == (r["text"] or "").encode() for r in got)
    assert docs.limit(0).withColumn("ids", bpe.encode(F.col("text"))).count() == 0


# --- substrings


def removed(docs, n=13):
    words = {d: (t or "").encode().split() for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - n + 1):
            first.setdefault(tuple(words[d][i : i + n]), d)
    out = {}
    for d, w in words.items():
        gone = {i + j for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < d for j in range(n)}
        out[d] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


def test_op10_equals_sql(spark):
    check(spark, substrings.op10_substring_dedup, substrings.ORACLE_SQL, "sf0.01")


def test_substrings_equal_brute_force(spark):
    rng = random.Random(2)
    passages = [[f"p{k}w{i}" for i in range(20)] for k in range(4)]
    docs = []
    for d in range(60):
        parts = [[f"u{rng.randrange(30)}" for _ in range(rng.randrange(8))] if rng.random() < 0.5 else rng.choice(passages)[rng.randrange(5) :] for _ in range(6)]
        docs.append((d * 3 % 61, " ".join(w for p in parts for w in p)))
    got = substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == removed(docs)
    assert {r["doc_id"]: [tuple(f) for f in r["factors"]] for r in got} == factors(docs)
    words = {d: t.split() for d, t in docs}
    for r in got:
        for f in r["factors"]:
            n = f["end"] - f["start"]
            assert n >= 13 and words[r["doc_id"]][f["start"] : f["end"]] == words[f["reference"]][f["at"] : f["at"] + n]


def factors(docs, n=13):
    """A parse of each document from the left, one window after the other."""
    words, first, out = {d: t.split() for d, t in docs}, {}, {}
    for d in sorted(words):
        w, out[d] = words[d], []
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        for i, g in enumerate(grams):
            known = first.get(g)
            if known and known[0] < d:
                last = out[d][-1] if out[d] else None
                if last and last[1] == i - 1 + n and last[2] == known[0] and last[3] + i - last[0] == known[1]:
                    out[d][-1] = (last[0], i + n, *last[2:])
                else:
                    out[d].append((i, i + n, *known))
        for i, g in enumerate(grams):
            first.setdefault(g, (d, i))
    return out


def test_substrings_of_odd_rows(spark):
    got = substrings.remove_repeats(odd_docs(spark, block="mine", body="x")).collect()
    assert len(got) == len(ODD) + 3 and sorted(r["n_removed"] for r in got)[-2:] == [0, 30_000]
    assert substrings.remove_repeats(odd_docs(spark).limit(0)).count() == 0


# --- Jaccard join


def test_op7_equals_sql(spark):
    check(spark, jaccard.op7_jaccard_join, jaccard.ORACLE_SQL, "sf0.01")


def groups(rows):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets, parent = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)] += [d] if d is not None else []
    return sorted(repr((d, len(sets[i]), min(least[find(i)], default=None))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("tile", [128, 8])
def test_groups_equal_brute_force(spark, monkeypatch, tile):
    rng, rows = random.Random(3), []
    for g, copies in enumerate([50, 20, 1]):
        start = [f"g{g}w{rng.randrange(500)}" for _ in range(120)]
        for _ in range(copies):
            w = list(start)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(120)] = f"m{rng.randrange(10**6)}"
            rows.append((len(rows) * 3 + 1, " ".join(w)))
    rows += [(None, rows[0][1]), (1000, None), (1001, ""), (1002, "a b"), (1003, "A  B"), (1004, "a b c"), (5000, rows[0][1]), (5000, "other text of the same id")]
    links = jaccard.links
    monkeypatch.setattr(jaccard, "links", lambda classes, percent: links(classes, percent, tile=tile, pivots=2, bins=7))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(repr(tuple(r)) for r in jaccard.jaccard_groups(docs).collect()) == groups(rows)


def thue_morse(n):
    """Two words of ``n`` letters that sums of powers of any odd factor can't tell apart from some length on."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_long_words_of_one_form_stay_apart(spark):
    for n in (1024, 4096):
        a, b = thue_morse(n)
        docs = spark.createDataFrame([(1, f"one two three four {a}"), (2, f"one two three four {b}")], "doc_id long, text string")
        assert {r["component_id"] for r in jaccard.jaccard_groups(docs).collect()} == {1, 2}
        twelve = " ".join(f"w{i}" for i in range(12))
        docs = spark.createDataFrame([(1, f"{twelve} {a}"), (2, f"{twelve} {b}")], "doc_id long, text string")
        assert [r["n_removed"] for r in substrings.remove_repeats(docs).collect()] == [0, 0]
        known = spark.createDataFrame([(0, a), (11, b)], "doc_id long, text string")
        assert [scoring.trains(np.array([i]))[0] for i in (0, 11)] == [True, False]
        assert {r["doc_id"]: r["n_known"] for r in scoring.score_texts(known).collect()} == {0: 2, 11: 1}
        stats = quality.with_stats(spark.createDataFrame([(f"x y {a} x y {b}\n{a}\n{b}",)], "text string")).first()
        assert (stats["n_dup_lines"], stats["n_repeat_words"]) == (0, 0)


def test_overlaps_are_whole_numbers():
    sets = [np.arange(700_001), np.arange(100, 700_101)]
    assert jaccard.overlaps(sets).tolist() == [[700_001, 699_901], [699_901, 700_001]]


def test_groups_of_odd_rows(spark):
    assert jaccard.jaccard_groups(odd_docs(spark, component_id="x", at="y")).count() == len(ODD) + 3
    assert jaccard.jaccard_groups(odd_docs(spark).limit(0)).count() == 0


# --- scores


def test_scores_equal_brute_force(spark):
    sf = str(DATA / "sf0.001")
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    tokens = {d: [*(t or "").encode().lower().split(), None] for d, t in docs}
    counts = collections.Counter(w for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = scoring.op3_lm_scores(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ws = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(counts[w] > 0 for w in ws), n, zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r["score"] <= 0
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_of_odd_rows(spark):
    got = scoring.score_texts(odd_docs(spark, block="x")).collect()
    assert len(got) == len(ODD) + 3 and {r["n_tokens"] for r in got if r["doc_id"] in (0, 1, 2)} == {1}
    assert scoring.score_texts(odd_docs(spark).limit(0)).count() == 0


def test_weights_recover_a_mixture():
    half = -scoring.STEPS
    for order in (2, 3):
        rows = np.array([[3, *[half] * (order - 1), 3 * scoring.STEPS, 900], [3, *[scoring.NEVER] * (order - 1), 3 * scoring.STEPS, 100]])
        w = scoring.learn_weights(rows, 1000, 1e-6)
        assert w[3][: order - 1].sum() > 0.8 and w[3].sum() == pytest.approx(1)
        assert (w[4] == w[3]).all() and (w[2] == w[0]).all()
        assert [x.tolist() for x in scoring._unpacked(scoring._packed(rows[:, 0], list(rows[:, 1:-1].T)), order)] == rows[:, :-1].T.tolist()


@pytest.mark.parametrize("order", [2, 3])
def test_model_equals_a_plain_one(spark, order):
    """Counts, held-out histogram, weights and scores from dictionaries of words."""
    rng = random.Random(order)
    docs = [(i, " ".join(rng.choice(["a", "b", "c", "d", "E", "rare"][: rng.randrange(2, 7)]) for _ in range(rng.randrange(0, 60)))) for i in range(80)]
    docs += [(100 + i, docs[i][1]) for i in range(10)]
    tokens = {d: [*t.lower().split(), None] for d, t in docs}
    trains = {d for d in tokens if scoring.trains(np.array([d]))[0]}
    counts, starts = collections.Counter(), len(trains)

    def grams(d, i, m):
        """The n-gram of m words that ends at word i; a text's begin stands before its first word."""
        return (*["^"] * (m - 1 - i), *tokens[d][max(0, i - m + 1) : i + 1])

    for d in trains:
        for i in range(len(tokens[d])):
            counts.update({grams(d, i, m) for m in range(1, order + 1)})

    def looked_up(d, i, own):
        ratios, bucket = [], 0
        for m in range(2, order + 1):
            context = (starts if i == 0 else counts[grams(d, i - 1, m - 1)]) - own
            ratios.insert(0, (counts[grams(d, i, m)] - own) / max(context, 1))
            bucket = (m - 2) * scoring.BUCKETS + context.bit_length() if context > 0 else bucket
        return bucket, ratios, counts[grams(d, i, 1)] - own

    n = sum(len(tokens[d]) for d in trains)
    kinds = sum(1 for g, c in counts.items() if len(g) == 1 and c)
    rows = collections.Counter()
    for d in trains:
        for i in range(len(tokens[d])):
            bucket, ratios, word = looked_up(d, i, 1)
            rows[(bucket, *(int(scoring._step(np.array([x]))[0]) for x in (*ratios, word)))] += 1
    weights = scoring.learn_weights(np.array([[*k, c] for k, c in rows.items()]), n, 1 / (kinds + 1))
    got = {r["doc_id"]: r for r in scoring.score_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), order=order).collect()}
    for d in tokens:
        want = 0.0
        for i in range(len(tokens[d])):
            bucket, ratios, word = looked_up(d, i, 0)
            w = weights[bucket]
            want += math.log10(sum(a * b for a, b in zip(w, ratios, strict=False)) + w[-2] * word / n + w[-1] / (kinds + 1))
        assert got[d]["score"] == pytest.approx(want, rel=1e-9) and got[d]["train_tokens"] == n


# --- languages


def test_languages_of_held_out_documents(spark):
    sf = str(DATA / "sf0.01")
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = langid.op2_language_id(spark, sf).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(lang) and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_languages_of_odd_rows(spark):
    labelled = spark.createDataFrame([(i, "en" if i % 2 else "fr", ("the cat sat on the mat " if i % 2 else "le chat est sur la table ") * 9) for i in range(60)], "doc_id long, lang string, text string")
    model = langid.learn(labelled, "text", "lang", "doc_id", 50, 10, 8)
    got = {r["text"]: r for r in langid.identify(odd_docs(spark, score="mine", langid_mean="x"), model).collect()}
    assert {t for t, r in got.items() if r["lang_pred"] == "und"} == {None, "", " \t\n", "\x00\x1f"}
    one = langid.identify(spark.createDataFrame([("le chat",), ("the cat",)], "text string"), model).collect()
    assert [r["lang_pred"] for r in one] == ["fr", "en"]
    assert langid.learn(labelled.limit(0), "text", "lang", "doc_id", 50, 10, 8) is None
    assert langid.identify(odd_docs(spark), None).count() == len(ODD) + 3


def plain_kneser_ney(counts, languages):
    """Probabilities of a character after others from dictionaries: {lang: {four characters: n}}."""
    kinds = len({g[-1:] for lang in languages for g in counts[lang]})
    tables = {}
    for lang in languages:
        tables[lang, 4] = dict(counts[lang])
        for k in (3, 2, 1):
            below = collections.Counter()
            for g, n in tables[lang, k + 1].items():
                below[g[1:]] += n > 0
            tables[lang, k] = dict(below)

    def p(lang, text):
        k = len(text)
        if not k:
            return 1 / (kinds + 1)
        c = tables[lang, k]
        once, twice = (sum(n == m for n in c.values()) for m in (1, 2))
        discount = once / (once + 2 * twice) if once else 0.5
        after = [n for g, n in c.items() if g[:-1] == text[:-1]]
        if not sum(after):
            return p(lang, text[1:])
        return max(c.get(text, 0) - discount, 0) / sum(after) + discount * len(after) / sum(after) * p(lang, text[1:])

    return p


def test_models_equal_a_plain_one():
    texts = {"de": "der hund und die katze und der wald und die hunde", "en": "the cat and the dog and the wood and the cats"}
    rows, counts = [], {}
    for lang, text in texts.items():
        (padded, kept, _), *_ = langid.sequences(pa.array([text]))
        grams = langid.keys(padded, kept)
        counts[lang] = collections.Counter("".join(chr(int(g) >> 16 * j & 0xFFFF) for j in (3, 2, 1, 0)) for g in grams)
        rows += [(lang, g, n) for g, n in zip(*np.unique(grams.view(np.int64), return_counts=True), strict=True)]
    model = langid.fit(pd.DataFrame(rows, columns=["lang", "gram", "n"]))
    p = plain_kneser_ney(counts, sorted(texts))
    tried = sorted({g for c in counts.values() for g in c} | {"zzzz", "undx", "   q", "e di", "xxth"})
    packed = np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(g)) for g in tried], np.uint64)
    got = np.exp(model.score(packed))
    for i, g in enumerate(tried):
        assert got[i].tolist() == pytest.approx([p(lang, g) for lang in sorted(texts)], rel=1e-4), g


def test_probabilities_sum_to_one():
    texts = pa.array(["abracadabra a bra", "cad ab"])
    counts = collections.Counter(k for p, kept, _ in langid.sequences(texts) for k in langid.keys(p, kept).tolist())
    model = langid.fit(pd.DataFrame({"lang": "x", "gram": np.array(list(counts), np.uint64).view(np.int64), "n": list(counts.values())}))
    for context in ("abr", "zzz", " ab"):
        seen = [int(g) for g in model.grams[1]]
        packed = np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(context)) | g for g in [*seen, ord("q")]], np.uint64)
        assert np.exp(model.score(packed)).sum() == pytest.approx(1, abs=1e-4)


def test_digests_are_of_kept_words(spark):
    docs = spark.createDataFrame([(1, "a  b\nc"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["kept_text"] for r in substrings.remove_repeats(docs, digest=True).collect()}
    assert got == {1: hashlib.sha256(b"a b c").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
