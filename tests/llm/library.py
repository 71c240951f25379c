"""The public tokenizer library with the same rank file."""

import base64
import functools

import tiktoken

from tessera.llm import bpe


@functools.cache
def library() -> tiktoken.Encoding:
    with open(bpe.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
