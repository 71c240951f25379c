"""Words, lines and their hashes for whole Arrow batches of texts, by numpy.

Texts are taken as they lie in an Arrow array, as UTF-8 bytes one after the other; words never cross
from one text to the next. A null text has no words.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_FACTOR = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 256
#: Keeps the first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a uint64 over all of them."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, which hangs on its bytes alone.

    Eight bytes at a time go into a state that ``mix`` spreads before the next eight, so that no two
    spans of up to eight bytes share a hash, and longer ones only by chance; sums of powers, which are
    quicker, make some unequal spans equal by their form. Spans above ``LONG_SPAN`` take BLAKE2.
    """
    lengths = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = mix(lengths.astype(np.uint64) * _STEP)
    todo = np.flatnonzero((lengths > 0) & (lengths <= LONG_SPAN))
    at = 0
    while len(todo):
        left = lengths[todo] - at
        out[todo] = mix((out[todo] ^ (lanes[starts[todo] + at] & _FIRST[np.minimum(left, 8)])) + _STEP)
        todo = todo[left > 8]
        at += 8
    for k in np.flatnonzero(lengths > LONG_SPAN).tolist():
        out[k] = np.frombuffer(hashlib.blake2b(padded[starts[k] : ends[k]], digest_size=8).digest(), "<u8")[0]
    return out


@dataclass
class Words:
    """The words of some texts: byte spans in ``data``, and where each text's bytes and words begin."""

    data: np.ndarray
    text_at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    word_at: np.ndarray

    def hashes(self, lower: bool = False) -> np.ndarray:
        return hash_spans(LOWER[self.data] if lower else self.data, self.starts, self.ends)


def split_words(data: np.ndarray, text_at: np.ndarray) -> Words:
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(IS_SPACE[data], out=inside[:-1])
    first = np.zeros(len(data) + 1, bool)
    first[text_at] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first))
    ends = np.flatnonzero(before & (~inside | first))
    return Words(data, text_at, starts, ends, np.searchsorted(starts, text_at))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow array of strings and where each begins; the last entry is the end."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def release() -> None:
    """Gives freed memory back to the system: a Python worker stays for other tasks, and what it keeps adds up on an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def pieces(text_at: np.ndarray, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most_bytes`` at most, so that arrays stay small; a longer text is alone."""
    low, n = 0, len(text_at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(text_at, text_at[low] + most_bytes, "right")) - 1)
        yield low, min(high, n)
        low = high


def in_pieces(texts: pa.Array, most_bytes: int = 1 << 20) -> Iterator[Words]:
    data, at = raw(texts)
    for low, high in pieces(at, most_bytes):
        yield split_words(data[at[low] : at[high]], at[low : high + 1] - at[low])
    release()


def windows(hashes: np.ndarray, word_at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all ``n`` successive words of one text, the words where they begin, and where each text's begin."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.zeros(len(word_at), np.int64)
    g = hashes[:count].copy()
    for j in range(1, n):
        g *= np.uint64(_FACTOR)
        g += hashes[j : j + count]
    whole = np.ones(count, bool)
    for j in range(1, n):  # a window that begins j words before a text's end is cut by it
        cut = word_at[1:] - j
        whole[cut[(cut >= 0) & (cut < count)]] = False
    at = np.flatnonzero(whole)
    return mix(g[at]), at, np.searchsorted(at, word_at)


def per_text(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``marks`` between successive entries of ``at``."""
    sums = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def owners(at: np.ndarray) -> np.ndarray:
    """The text to which each of the at[-1] items belongs."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))
