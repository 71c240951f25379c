"""Alignment of two tokenizers' tokens by their bytes.

Both tokenizers cut the same bytes, each into intervals that follow one another. The intervals of B
are a static index, sorted by where they start and end; each token of A stabs it with its own
interval and finds by bisection the first and the last token of B that it overlaps. Where what one
token of A overlaps ends before what the next one overlaps begins, no token of B spans the gap: such
gaps cut the tokens into groups, and the two tokens that end there are linked.

Two tokens that end together are, one of them, the end of the other's bytes. So the pairs that can
ever be linked follow from the two vocabularies, whatever the corpus: no more than the bytes of all
tokens of both. A count for each of these pairs is all that is gathered or broadcast.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import text as T
from tessera.llm.common import bound_batches, materialize, settle, table

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Code points of a batch's texts that are encoded at once.
MOST_CHARS = 1 << 20
#: White space runs of so many characters go to the tokenizer's own library: the faster one gives up on them.
LONG_SPACE = re.compile(r"\s{1000}")
#: Characters of words that a worker keeps with their alignment; beyond them it starts anew.
MOST_KEPT = 3_000_000
#: Words end where a space follows something that is no white space.
_WORD = re.compile(r"\s*\S+(?:[^\S ]\s*\S*)*|\s+")
RESULT = "struct<n_a:long,n_b:long,n_groups:long,n_links:long,groups:string,links:binary>"


def byte_level() -> dict[str, int]:
    """The byte for which each character stands in a byte-level vocabulary: printable ones are themselves, others come above 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """The bytes of each id, one after the other, and its decimal digits."""

    def __init__(self, entries: list[bytes]):
        self.entries = entries
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        told = [str(i).encode() for i in range(len(entries))]
        self.digits = np.array([len(t) for t in told], np.int64)
        self.told = np.zeros((len(entries), int(self.digits.max()) + 1), np.uint8)
        for k, t in enumerate(told):
            self.told[k, : len(t)] = list(t)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        to = np.cumsum(lengths)
        return self.flat[np.repeat(self.at[ids] - (to - lengths), lengths) + np.arange(to[-1] if len(to) else 0)]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(x) for x in lists], np.int64)
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(counts.sum())), counts


class Aligner:
    """Both tokenizers and the pairs of ids that can be linked, sorted by ``a << 32 | b``."""

    def __init__(self, a_path: str, b_path: str):
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.plain = Tokenizer.from_file(a_path)
        self.plain.encode_special_tokens = True
        special = {t["id"] for t in spec["added_tokens"]}
        of = byte_level()
        vocab = {bytes(map(of.__getitem__, w)): i for w, i in spec["model"]["vocab"].items() if i not in special}
        entries = [b""] * (max([*vocab.values(), *special]) + 1)
        for w, i in vocab.items():
            entries[i] = w
        self.a = Vocabulary(entries)
        # ids that rise with the merges are ranks, and ranks are all that the faster library needs
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" ")).translate({ord(c): b for c, b in of.items()}).encode("latin-1")] for m in spec["model"]["merges"]]
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab, special_tokens={}) if merged == list(range(256, 256 + len(merged))) else None
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        ids = range(self.pieces.get_piece_size())
        self.b = Vocabulary([bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.pieces.id_to_piece(i)) for i in ids)])
        self.space = self.pieces.piece_to_id("▁")
        # no token of either goes on beyond a space that follows something else, so texts can be aligned word by word
        probe = "a  b\tcﬁ é  é　x "
        apart = not any(re.search("[^▁]▁", self.pieces.id_to_piece(i)) for i in ids) and self.space != self.pieces.unk_id()
        self.by_word = self.fast is not None and apart and self.pieces.normalize(probe) == "▁" + probe.replace(" ", "▁")
        self.forget()
        self.pairs = self._pairs()
        self.pair_b = self.pairs & 0xFFFFFFFF

    def _pairs(self) -> np.ndarray:
        ids_b: dict[bytes, list[int]] = {}
        for i, w in enumerate(self.b.entries):
            ids_b.setdefault(w, []).append(i)
        ids_a = {w: i for i, w in enumerate(self.a.entries) if w}
        found = [a << 32 | b for w, a in ids_a.items() for k in range(len(w)) for b in ids_b.get(w[k:], ())]
        found += [ids_a[w[k:]] << 32 | b for b, w in enumerate(self.b.entries) for k in range(1, len(w)) if w[k:] in ids_a]
        return np.unique(np.array(found, np.int64))

    def forget(self) -> None:
        self.kept: dict[str, int] = {}
        self.told: list[str] = []
        self.chars = 0
        self.numbers = np.zeros((0, 4), np.int64)
        self.links, self.links_at = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def encode_a(self, full: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has. Words that end in no white space are encoded as one text and cut apart."""
        one = [self.by_word and not t[-1].isspace() and not LONG_SPACE.search(t) for t in full]
        rest = [t for t, x in zip(full, one, strict=True) if not x]
        if self.fast is None:
            own = [e.ids for e in self.plain.encode_batch_fast(rest, add_special_tokens=False)]
        else:
            own = [self.plain.encode(t, add_special_tokens=False).ids if LONG_SPACE.search(t) else self.fast.encode_ordinary(t) for t in rest]
        if not any(one):
            return _flat(own)
        joined = np.array(self.fast.encode_ordinary("".join(itertools.compress(full, one))), np.int64)
        cuts = np.searchsorted(np.cumsum(self.a.lengths[joined]), np.cumsum([len(t.encode()) for t in itertools.compress(full, one)]), "right")
        at, mine = np.array(one), np.empty(len(full), np.int64)
        some, counts = _flat(own)
        mine[at], mine[~at] = np.diff(cuts, prepend=0), counts
        ids, of_one = np.empty(int(mine.sum()), np.int64), np.repeat(at, mine)
        ids[of_one], ids[~of_one] = joined, some
        return ids, mine

    def encode_b(self, full: list[str]) -> list[list[int]]:
        """Of texts with a space before them, which the tokenizer adds itself, but for empty ones."""
        return [own if t != " " else [self.space] for t, own in zip(full, self.pieces.encode([t[1:] for t in full], num_threads=1), strict=True)]

    def align(self, texts: list[str | None]) -> list[pa.Array]:
        """The fields of RESULT for some texts: the alignments of their words, one after the other."""
        n = len(texts)
        full = [" " + t for t in texts if t]
        of = np.array([k for k, t in enumerate(texts) if t], np.int64)
        words = [_WORD.findall(t) for t in full] if self.by_word else [[t] for t in full]
        if self.chars > MOST_KEPT:
            self.forget()
        if new := [w for w in set(itertools.chain.from_iterable(words)) if w not in self.kept]:
            self.learn(new)
        counts = np.array(list(map(len, words)), np.int64)
        rows = np.fromiter(map(self.kept.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(counts.sum()))
        ends = np.cumsum(counts)
        sums = np.add.reduceat(self.numbers[rows], ends - counts) if len(rows) else np.zeros((0, 4), np.int64)
        good = sums[:, 3] == 0
        numbers = np.zeros((n, 3), np.int64)
        numbers[of[good]] = sums[good, :3]
        told, links = [""] * n, [b""] * n
        cut = zstandard.ZstdCompressor(level=1)
        for k, low, high in zip(of[good].tolist(), (ends - counts)[good].tolist(), ends[good].tolist(), strict=True):
            own = rows[low:high]
            told[k] = ";".join(map(self.told.__getitem__, own.tolist()))
            size = self.links_at[own + 1] - self.links_at[own]
            to = np.cumsum(size)
            held = self.links[np.repeat(self.links_at[own] - (to - size), size) + np.arange(to[-1])]
            links[k] = cut.compress(np.ascontiguousarray(held.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes())
        each = [pa.array(np.ascontiguousarray(numbers[:, k])) for k in (0, 1, 2, 2)]
        return [*each, pa.array(told, pa.string()), pa.array(links, pa.binary())]

    def learn(self, full: list[str]) -> None:
        """Aligns words, or whole texts, and keeps what was found: numbers of tokens and groups, whether bytes differ, groups and links."""
        (a, n_a), (b, n_b) = self.encode_a(full), _flat(self.encode_b(full))
        data = [t.encode() for t in full]
        size = np.array([len(d) for d in data], np.int64)
        doc = np.arange(len(full))
        same = np.ones(len(full), bool)
        for vocabulary, ids, counts in ((self.a, a, n_a), (self.b, b, n_b)):
            same &= np.bincount(np.repeat(doc, counts), vocabulary.lengths[ids], minlength=len(full)).astype(np.int64) == size
        for vocabulary, ids, counts in ((self.a, a, n_a), (self.b, b, n_b)):
            wrong = vocabulary.joined(ids[np.repeat(same, counts)]) != np.frombuffer(b"".join(itertools.compress(data, same.tolist())), np.uint8)
            if wrong.any():
                owner = np.repeat(np.flatnonzero(same), size[same])
                same[owner[wrong]] = False
        a, b = a[np.repeat(same, n_a)], b[np.repeat(same, n_b)]
        size = size[same]

        # the intervals of all texts lie on one axis, text after text
        a_end, b_end = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        a_start, b_start = a_end - self.a.lengths[a], b_end - self.b.lengths[b]
        first, last = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left") - 1
        unspanned = np.ones(len(a), bool)
        unspanned[:-1] = last[:-1] < first[1:]
        a_last = np.flatnonzero(unspanned)
        b_last = last[a_last]
        linked = np.searchsorted(self.pairs, a[a_last] << 32 | b[b_last])
        text_end = np.cumsum(size)
        group_to = np.searchsorted(a_end[a_last], text_end, "right")
        groups, held = self.written(a, b, a_last, b_last, group_to)
        n_groups = np.diff(group_to, prepend=0)
        numbers, told = np.zeros((len(full), 4), np.int64), [""] * len(full)
        numbers[:, 3] = ~same
        numbers[same, :3] = np.stack([n_a[same], n_b[same], n_groups], axis=1)
        for k, (x, y) in zip(np.flatnonzero(same).tolist(), held, strict=True):
            told[k] = groups[x:y]
        self.kept.update(zip(full, range(len(self.told), len(self.told) + len(full)), strict=True))
        self.told += told
        self.chars += sum(map(len, full))
        self.numbers = np.concatenate([self.numbers, numbers])
        self.links = np.concatenate([self.links, linked])
        self.links_at = np.concatenate([self.links_at, self.links_at[-1] + np.cumsum(numbers[:, 2])])

    def written(self, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, group_to: np.ndarray) -> tuple[str, list[tuple[int, int]]]:
        """The groups of all texts as one string, and where each text's lie in it."""
        groups = np.arange(len(a_last))
        of_a, of_b = np.repeat(groups, np.diff(a_last, prepend=-1)), np.repeat(groups, np.diff(b_last, prepend=-1))
        at_a = np.arange(len(a)) + (b_last[of_a] + 1 - np.diff(b_last, prepend=-1)[of_a])
        at_b = np.arange(len(b)) + a_last[of_b] + 1
        marks = np.full(len(a) + len(b), ord(","), np.uint8)
        marks[at_a[a_last]] = ord("|")
        marks[at_b[b_last]] = ord(";")
        width = max(self.a.told.shape[1], self.b.told.shape[1])
        rows, digits = np.zeros((len(marks), width), np.uint8), np.empty(len(marks), np.int64)
        for vocabulary, ids, at in ((self.a, a, at_a), (self.b, b, at_b)):
            rows[at, : vocabulary.told.shape[1]] = vocabulary.told[ids]
            digits[at] = vocabulary.digits[ids]
        rows[np.arange(len(marks)), digits] = marks
        string = rows[np.arange(width) <= digits[:, None]].tobytes().decode("ascii")
        ends = np.concatenate([[0], np.cumsum(digits + 1)])
        to = ends[at_b[b_last[group_to - 1]] + 1] if len(group_to) else np.empty(0, np.int64)
        begin = np.concatenate([[0], to[:-1]])
        return string, list(zip(begin.tolist(), (to - 1).tolist(), strict=True))  # without the last separator


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def links_of(blob: bytes) -> np.ndarray:
    """The places of a text's links in ``Aligner.pairs``, in their order."""
    if not blob:
        return np.empty(0, np.int64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)


def aligned(text: Column, a_path: str = A_PATH, b_path: str = B_PATH, most_chars: int = MOST_CHARS) -> Column:
    """A struct of RESULT: numbers of tokens, groups and links of a text, the groups as ``a1,a2|b1;...`` and its links (``links_of``).

    A null or empty text, and one that either tokenizer does not give back byte for byte, has no tokens.
    Equal texts get equal results; an empty table stays empty.
    """
    bound_batches(SparkSession.active())

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        own, parts, some, chars = aligner(a_path, b_path), [], [], 0
        for t in itertools.chain.from_iterable(texts.slice(low, 256).to_pylist() for low in range(0, len(texts), 256)):
            some.append(t)
            chars += len(t or "")
            if chars > most_chars:
                parts.append(own.align(some))
                some, chars = [], 0
        parts.append(own.align(some))
        T.release()
        return pa.StructArray.from_arrays([pa.concat_arrays(x) for x in zip(*parts, strict=True)], ["n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    return run(text)


def link_counts(rows: DataFrame, links: str = "links", a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """(pair, n): how many links of all rows hold each pair, by its place in ``Aligner.pairs``; pairs without a link have no row.

    A task adds up its links before anything is shuffled; it has a row for each pair at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(aligner(a_path, b_path).pairs), np.int64)
        for batch in batches:
            for blob in batch.column(0):
                if blob.is_valid:
                    pair, n = np.unique(links_of(blob.as_py()), return_counts=True)
                    total[pair] += n
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(pair), "n": pa.array(total[pair])})

    return rows.select(links).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def judged(rows: DataFrame, links: str = "links", a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """``rows`` with n_best, the links whose pair is as frequent in all rows as the most frequent one of its B id, and count_sum, the counts of all links.

    ``rows`` is read twice and should be a written table. The counts that are gathered and broadcast are one
    number for each pair of the vocabularies' at most. Null links count as none.
    """
    found = link_counts(rows, links, a_path, b_path).toPandas()
    own = aligner(a_path, b_path)
    counts, best = np.zeros(len(own.pairs), np.int64), np.zeros(len(own.b.entries), np.int64)
    counts[found["pair"]] = found["n"]
    np.maximum.at(best, own.pair_b, counts)
    shipped = rows.sparkSession.sparkContext.broadcast((counts, counts == best[own.pair_b]))

    @F.arrow_udf("struct<n_best:long,count_sum:long>")
    def run(blobs: pa.Array) -> pa.Array:
        n, is_best = shipped.value
        each = [links_of(b or b"") for b in blobs.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([int(is_best[x].sum()) for x in each], pa.int64()), pa.array([int(n[x].sum()) for x in each], pa.int64())], ["n_best", "count_sum"])

    return rows.drop("n_best", "count_sum").withColumn("align_z", run(F.col(links))).select("*", "align_z.*").drop("align_z")


def align(docs: DataFrame, text: str = "text", key: str = "doc_id", a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """(key, groups, n_a, n_b, n_groups, n_links, n_best, count_sum) of each row of ``docs``; see ``aligned`` and ``judged``.

    Null and repeated keys keep their rows; columns of other names play no part. Written once, with the groups.
    """

    def build() -> DataFrame:
        return judged(materialize(docs.select(key, aligned(F.col(text), a_path, b_path).alias("z")).select(key, "z.*")), "links", a_path, b_path).drop("links")

    return settle(docs.sparkSession, build)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = F.when(F.col("z.groups") == "", "").otherwise(F.sha2(F.col("z.groups").cast("binary"), 256)).alias("groups_sha256")

    def build() -> DataFrame:
        rows = docs.select("doc_id", aligned(F.col("text")).alias("z")).select("doc_id", "z.n_a", "z.n_b", "z.n_groups", "z.n_links", digest, "z.links")
        return judged(materialize(rows)).drop("links")

    return settle(spark, build)
