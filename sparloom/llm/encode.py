"""Encoding of a corpus with a public byte-level BPE vocabulary.

Texts are cut into words by the vocabulary's pattern, each word is merged from
its bytes. The merge uses a *segment tree* over the ranks of adjacent pairs: the
root holds the lowest rank and, of equal ones, the leftmost position; a merge
changes three leaves and their paths to the root, until the root holds no rank.
A word of n bytes costs O(n log n), also where a "word" is a megabyte of blanks.
Words repeat, so each worker keeps a bounded dictionary of merged words.

Defined results: a null text and an empty text both give the empty list; special
tokens are never produced, their spelling in a text is ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the published word pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS = 200_000
NO_RANK = 1 << 40


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file as bytes -> rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one word.

    Leaf i of the tree holds the rank of the pair that starts at byte i, or
    NO_RANK; keys are ``rank * n + i`` so that the minimum is the leftmost of
    the lowest.
    """
    n = len(word)
    if n == 1:
        return [ranks[word]]
    if (whole := ranks.get(word)) is not None and n <= 2:
        return [whole]
    size = 1 << (n - 1).bit_length()
    none = NO_RANK * n
    tree = [none] * (2 * size)
    for i in range(n - 1):
        rank = ranks.get(word[i:i + 2])
        if rank is not None:
            tree[size + i] = rank * n + i
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    end = list(range(1, n + 1))  # where the token that starts at i ends
    before = list(range(-1, n - 1))  # where the token before it starts

    def put(i: int, key: int) -> None:
        node = size + i
        tree[node] = key
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            least = left if left < right else right
            if tree[node] == least:
                break
            tree[node] = least
            node >>= 1

    def pair_key(i: int) -> int:
        middle = end[i]
        if middle >= n:
            return none
        rank = ranks.get(word[i:end[middle]])
        return none if rank is None else rank * n + i

    while tree[1] < none:
        i = tree[1] % n
        middle = end[i]
        end[i] = stop = end[middle]
        if stop < n:
            before[stop] = i
        put(middle, none)
        put(i, pair_key(i))
        if before[i] >= 0:
            put(before[i], pair_key(before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i:end[i]]])
        i = end[i]
    return ids


class Encoder:
    """Encodes texts; one for each worker and vocabulary."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import regex

        self.ranks = load_ranks(path)
        self.words = regex.compile(pattern)
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        known, ranks = self.known, self.ranks
        for found in self.words.finditer(text):
            word = found.group()
            got = known.get(word)
            if got is None:
                got = merge_word(word.encode(), ranks)
                if len(word) <= 64:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known[word] = got
            ids += got
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str = f"{TOKENIZER_DIR}/{VOCABULARY}") -> DataFrame:
    """(key, ids) of each row; map-only, Arrow batches in and out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            encoded = [own.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(encoded) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in encoded], out=offsets[1:])
            flat = np.fromiter((i for ids in encoded for i in ids), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["key_", "ids"])

    picked = df.select(F.col(key).cast("long").alias("key_"), F.col(text).alias("text_"))
    return picked.mapInArrow(run, "key_ long, ids array<int>").withColumnRenamed("key_", key)


def encode_documents(df: DataFrame, vocabulary: str = f"{TOKENIZER_DIR}/{VOCABULARY}") -> DataFrame:
    return encode_column(df, "doc_id", "text", vocabulary)
