"""Filling containers of a fixed token capacity with whole texts.

Texts that are alike should share a container, and little space may stay
unused. So documents are placed on a space-filling curve and neighbours along
the curve are packed:

1. every text becomes its size in tokens and a hashed word vector, projected to
   a few dimensions by signs that follow from the word's hash;
2. the projected point, made uniform per dimension, gets its Hilbert key;
3. rows are range-sorted by (key, id), so that many equal texts, which share a
   key, are still spread over partitions;
4. each partition walks its stretch of the curve in blocks of neighbours and
   packs a block best-fit decreasing into the containers still open, at most
   ``OPEN`` of them; fuller ones are closed first.

Only (id, size, key) is exchanged, never a text.

Defined results: a text longer than the capacity is cut into full containers of
its own and a rest that is packed like any text; no other text is cut. A null
or empty text has size 0 and is assigned to a container all the same. Repeated
rows are items each. Container ids are unique, without gaps inside a partition.
An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sparloom.llm.encode import TOKENIZER_DIR, VOCABULARY, encoder

CAPACITY = 2048
DIMENSIONS = 3
BITS = 10
BLOCK = 1024
OPEN = 64
ROWS_PER_PARTITION = 40_000
_WORD = re.compile(r"\w+")


def hilbert_key(point: list[int], bits: int = BITS) -> int:
    """Position of an integer point on the Hilbert curve (Skilling's transform)."""
    x, n = list(point), len(point)
    bit = 1 << (bits - 1)
    while bit > 1:  # undo the excess rotations
        low = bit - 1
        for i in range(n):
            if x[i] & bit:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
        bit >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip, bit = 0, 1 << (bits - 1)
    while bit > 1:
        if x[n - 1] & bit:
            flip ^= bit - 1
        bit >>= 1
    x = [v ^ flip for v in x]
    key = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | (v >> b & 1)
    return key


class Projector:
    """Text -> grid point. Word signs are kept in a bounded dictionary."""

    def __init__(self, dimensions: int = DIMENSIONS, bits: int = BITS):
        self.dimensions, self.bits, self.signs = dimensions, bits, {}

    def _signs(self, word: str) -> tuple[int, ...]:
        got = self.signs.get(word)
        if got is None:
            digest = hashlib.blake2b(word.encode(), digest_size=self.dimensions).digest()
            got = tuple(1 if b & 1 else -1 for b in digest)
            if len(self.signs) >= 200_000:
                self.signs.clear()
            self.signs[word] = got
        return got

    def point(self, text: str | None) -> list[int]:
        total, n = [0] * self.dimensions, 0
        for word in set(_WORD.findall((text or "").lower())):
            for i, sign in enumerate(self._signs(word)):
                total[i] += sign
            n += 1
        top = (1 << self.bits) - 1
        scale = 1 / math.sqrt(2 * n) if n else 0.0
        return [min(top, int((1 + math.erf(t * scale)) / 2 * (top + 1))) for t in total]


def _measure(vocabulary: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, project = encoder(vocabulary), Projector()
        for pdf in batches:
            texts = pdf["text_"].tolist()
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"],
                "size": [len(own.encode(t)) if isinstance(t, str) else 0 for t in texts],
                "key": [hilbert_key(project.point(t if isinstance(t, str) else "")) for t in texts],
            })

    return run


class Packer:
    """Open containers of one stretch of the curve."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: list[tuple[int, int]] = []  # (room, container id), by room

    def new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def put(self, size: int) -> int:
        at = bisect.bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, container = self.open.pop(at)
        else:
            room, container = self.capacity, self.new()
        bisect.insort(self.open, (room - size, container))
        return container

    def trim(self, keep: int) -> None:
        self.open = self.open[max(0, len(self.open) - keep):]


def pack_block(items: list[tuple[int, int]], packer: Packer) -> list[tuple[int, int, int, int, int]]:
    """(container_id, doc_id, part, start_token, n_tokens) of (doc_id, size) items."""
    rows, rest = [], []
    for doc_id, size in items:
        part = start = 0
        while size - start > packer.capacity:
            rows.append((packer.new(), doc_id, part, start, packer.capacity))
            start += packer.capacity
            part += 1
        rest.append((size - start, doc_id, part, start))
    for size, doc_id, part, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        rows.append((packer.put(size), doc_id, part, start, size))
    return rows


PACK_SCHEMA = "container_id long, doc_id long, part int, start_token long, n_tokens long"


def _pack(capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, block = Packer(capacity, TaskContext.get().partitionId() << 36), []

        def flush() -> pd.DataFrame:
            rows = pack_block(block, packer)
            packer.trim(OPEN)
            block.clear()
            return pd.DataFrame(rows, columns=["container_id", "doc_id", "part", "start_token", "n_tokens"])

        for pdf in batches:
            for doc_id, size in zip(pdf["doc_id"], pdf["size"]):
                block.append((doc_id, int(size)))
                if len(block) >= BLOCK:
                    yield flush()
        if block:
            yield flush()

    return run


def measured(df: DataFrame, vocabulary: str = f"{TOKENIZER_DIR}/{VOCABULARY}") -> DataFrame:
    """doc_id, size, key (map-only)."""
    picked = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text_"))
    return picked.mapInPandas(_measure(vocabulary), "doc_id long, size long, key long")


def pack(items: DataFrame, capacity: int = CAPACITY, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """Containers of ``items`` (doc_id, size, key); ``items`` should be a written
    table, since its rows are counted and sampled before they are sorted."""
    partitions = max(1, math.ceil(items.count() / rows_per_partition))
    ordered = items.repartitionByRange(partitions, "key", "doc_id").sortWithinPartitions("key", "doc_id")
    return ordered.mapInPandas(_pack(capacity), PACK_SCHEMA)


def fill_report(containers: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Number of containers, tokens in them, and the share of space used."""
    per = containers.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return per.agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"),
        F.bround(F.try_divide(F.sum("used"), F.count(F.lit(1)) * capacity), 6).alias("fill"),
    )
