"""Records of evaluation splits that also occur in the training split.

Two records are the same task if their task ids are equal, their prompt hashes
are equal, or their statements are equal or nearly so. Statements:

1. A statement becomes its words (markup and case aside). Equal word sequences
   of one side form a *class*; only classes are compared, membership is joined
   back at the end.
2. A class is cut into *content-defined chunks*: a cut follows each word whose
   rolling hash falls below a bound, so an edit moves no cut but its own. The
   chunks of a statement are about three words long; of short statements two
   words or one, and statements near a bound of length get both kinds
   (``LEVELS``), so that any two near classes have one in common.
3. Chunk digests of both splits are joined, and the lengths of shared chunks are
   summed to overlap fractions. Not all of them: in one order of all chunks, rarest
   first, a pair whose overlap fraction is at least the ``theta`` of its level
   shares a chunk within the first chunks of both that make up ``1 - theta`` of
   their words. Only these are exchanged, the commonest are left to the end; but
   none is left out for being frequent. A digest with many rows is dealt over
   blocks that meet each other once. Beside its digest a row carries a bitmap of
   its words: two near classes differ in few words, hence in few bits, and a pair
   that differs in more never leaves the join. Neither filter loses a pair.
   The digests of most pairs (``HOT``) are the last in the order, so a pair whose
   first common chunk is one of them has only such in common, and these alone hold
   ``theta`` of its words. Where a join would let most of them meet, they are not
   joined: all classes of that kind are compared by their bitmaps alone. Those of a block of training lie in one lane for each bit,
   64 in a number, and the lanes of the bits of a class of evaluation are added, the
   rarest first, until too few of them are set in those that are not near. Classes
   of more than ``LONG`` words have full bitmaps; they are joined by all digests.
4. What is left is checked by common words (``SHARE`` of the longer one) and their
   longest common subsequence; only there texts are fetched.
5. Groups of edited copies are closed: a class also meets the classes linked with
   its nearest ones and with their nearest ones (``CENTRES`` each), so that two
   copies whose edits together leave too few chunks whole are compared as well.
   That is some few candidates for each pair of a group, and none outside of groups.

A near pair is certain to be found if both statements have at most 24 words, or if
the chunks it shares hold ``theta`` of the words of the longer one, however frequent
they are. Two statements apart from any
group can be missed if edits are strewn so evenly that fewer chunks survive.
Common chunks that make up more than ``theta`` of the words of most statements let
all pairs of classes meet in the lanes: that part is quadratic, with a small factor.

Defined results: ids null, ``""``, ``"None"`` or blank never match, blank or
null hashes neither; a statement without words (null, empty) or of the words of
a placeholder (``PLACEHOLDERS``) only matches by id or hash; text of scripts
without blanks between words has a word for each character; short statements and
very long ones are compared as all others; each repeated row makes its own pair; a pair that matches in several ways
is one row; with either side empty there are no pairs.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK = 20_000
COMMON = 30_000
#: One word in so many ends a chunk, for statements of these lengths, and the overlap fraction (theta) to find.
LEVELS = [(1, 0, 24, 0.72), (2, 17, 96, 0.12), (3, 69, 1 << 60, 0.2)]
BITS = 512
#: Of the listed chunks, those of more pairs of classes than this are hot, the first ``HOT`` of them; words of a class that is compared in lanes, at most.
HOT_PAIRS = 200_000
HOT = 2_048
LONG = 256
#: Classes of either side in a block of lanes at most; tasks at least, if their blocks keep ``LEAST_BLOCK`` classes; words of a lane added at once.
LANE = 1 << 19
TASKS = 12
LEAST_BLOCK = 4_096
TILE = 1_024
#: Pairs compared in lanes in the time of one that meets in the join.
LANES_PER_MEETING = 4
#: Nearest classes through which a class meets those of its group.
CENTRES = 4
MIX = 0x9E3779B97F4A7C15
MASK = 0xFFFFFFFFFFFFFFFF
SHARE = 0.72
ORDER = 0.7
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>|&(?:nbsp|lt|gt|amp|quot|#\d+);")
#: Scripts without blanks: Thai, Lao, Myanmar, Khmer, kana, Chinese characters.
_SINGLE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORDS = re.compile(rf"[{_SINGLE}]|[^\W_{_SINGLE}]+")
#: Words that stand for a statement that is not there.
PLACEHOLDERS = {
    "removed", "statement removed", "question removed", "text removed", "content removed", "deleted", "redacted", "missing", "placeholder",
    "none", "null", "nan", "n a", "na", "empty", "unknown", "tbd", "todo", "not available", "see original",
}


def words_of(text: str) -> list[str]:
    return _WORDS.findall(_TAG.sub(" ", text).casefold())


class Chunker:
    """Content-defined chunks and word bitmaps; hashes of words are kept in a bounded dictionary."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= 200_000:
                self.known.clear()
            got = self.known[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
        return got

    def tokens(self, words: list[str]) -> list[int]:
        """One number for each word with its occurrence."""
        seen: dict[str, int] = {}
        out = []
        for word in words:
            seen[word] = n = seen.get(word, 0) + 1
            out.append((self._hash(word) + n * MIX) & MASK)
        return out

    def chunks(self, words: list[str], mean: int) -> dict[int, int]:
        """Digest of each chunk and the number of words it covers, repeats included."""
        if mean == 1:
            return {signed(t): 1 for t in self.tokens(words)}
        out: dict[int, int] = {}
        digest, size = mean, 0
        for word in words:
            value = self._hash(word)
            digest = ((digest ^ value) * MIX) & MASK
            digest ^= digest >> 29
            size += 1
            if value % mean == 0:
                key = signed(digest)
                out[key] = out.get(key, 0) + size
                digest, size = mean, 0
        if size:
            key = signed(digest)
            out[key] = out.get(key, 0) + size
        return out

    def bitmap(self, words: list[str]) -> list[int]:
        """``BITS`` bits in signed 64-bit numbers, one set for each word with its occurrence."""
        bits = 0
        for token in self.tokens(words):
            bits |= 1 << (((token * MIX) & MASK) >> 32) % BITS
        return [signed(bits >> at & MASK) for at in range(0, BITS, 64)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


class Order:
    """All chunks in one order, rarest first; only the common ones are listed."""

    def __init__(self, listed: list[tuple[int, int, int]]):
        self.pairs = {digest: n_a * n_b for digest, n_a, n_b in listed}
        self.counts = {digest: (n_a, n_b) for digest, n_a, n_b in listed if max(n_a, n_b) > BLOCK}
        #: They are the last of the order.
        self.hot = set([d for d, n_a, n_b in listed if n_a * n_b > HOT_PAIRS][:HOT])

    def prefix(self, chunks: dict[int, int], theta: float) -> list[int]:
        """The first chunks, of which two classes with enough overlap share one."""
        left = (1 - theta) * sum(chunks.values()) + 1e-9
        out = []
        for digest in sorted(chunks, key=lambda d: (d in self.hot, self.pairs.get(d, 0), d)):
            if left < 0:
                break
            out.append(digest)
            left -= chunks[digest]
        return out

    def rests_on_hot(self, chunks: dict[int, int], theta: float) -> bool:
        """Whether enough overlap is possible in hot chunks alone."""
        return bool(self.hot) and sum(n for d, n in chunks.items() if d in self.hot) >= theta * sum(chunks.values()) - 1e-9

    def keys(self, digest: int, side: str, own: int) -> list[int]:
        """Keys under which a row of a digest meets those of the other side: one, or one for each pair of blocks."""
        counts = self.counts.get(digest)
        if counts is None:
            return [digest]
        n_a, n_b = (-(-n // BLOCK) for n in counts)
        met = [(own % n_a, j) for j in range(n_b)] if side == "train" else [(i, own % n_b) for i in range(n_a)]
        return [signed(((digest & MASK) + (i * n_b + j) * MIX) & MASK) for i, j in met]


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, bit-parallel over the words of ``a``."""
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def near(a: list[str], b: list[str], common: int) -> bool:
    """Whether ``common`` shared words are enough of the longer one, and enough of them in order."""
    return common >= SHARE * max(len(a), len(b)) and lcs_length(a, b) >= ORDER * common


def same_statement(a: list[str], b: list[str]) -> bool:
    """Whether enough words of the longer one recur in the other, in order."""
    return near(a, b, sum((Counter(a) & Counter(b)).values()))


def _classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text in pdf["statement"]:
            words = words_of(text) if isinstance(text, str) else []
            joined = " ".join(words)
            rows.append((hashlib.blake2b(joined.encode(), digest_size=16).hexdigest(), len(words), joined) if words and joined not in PLACEHOLDERS else (None, 0, None))
        out = pd.DataFrame(rows, columns=["cls", "n_words", "words"])
        yield pd.concat([pdf[["item_no", "side", "split", "source", "task_key", "hash_key"]].reset_index(drop=True), out], axis=1)


RECORD_SCHEMA = "item_no long, side string, split string, source string, task_key string, hash_key string, cls string, n_words int, words string"


def with_classes(records: DataFrame) -> DataFrame:
    """Records (item_no, side, split, source, task_key, hash_key, statement) with their class."""
    return records.mapInPandas(_classes, RECORD_SCHEMA)


def id_key(column: Column) -> Column:
    """A task id, null where absent."""
    return F.when(~F.trim(column).isin("", "None"), column)


def hash_key(column: Column) -> Column:
    """A hash without case, null where blank."""
    return F.nullif(F.lower(F.trim(column)), F.lit(""))


SIGNED = [f"s{i}" for i in range(BITS // 64)]
CHUNK_SCHEMA = "side string, id long, n_words int, theta double, digests array<long>, sizes array<int>, " + ", ".join(f"{c} long" for c in SIGNED)


def class_id(cls: str) -> int:
    """64 bits of a class; equal ones of different classes only make one more candidate."""
    return signed(int(cls[:16], 16))


def _chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    chunker = Chunker()
    for pdf in batches:
        rows = []
        for side, cls, joined in zip(pdf["side"], pdf["cls"], pdf["words"]):
            words = joined.split(" ")
            bits = chunker.bitmap(words)
            for mean, least, most, theta in LEVELS:
                if not least <= len(words) <= most:
                    continue
                chunks = chunker.chunks(words, mean)
                rows.append((side, class_id(cls), len(words), theta, list(chunks), list(chunks.values()), *bits))
        yield pd.DataFrame(rows, columns=["side", "id", "n_words", "theta", "digests", "sizes", *SIGNED])


def common_chunks(chunked: DataFrame) -> list[tuple[int, int, int]]:
    """(digest, classes of training, of evaluation) of the chunks of most pairs, at most ``COMMON``."""
    is_a = F.col("side") == "train"
    top = (
        chunked.select(is_a.alias("is_a"), F.explode("digests").alias("digest"))
        .groupBy("digest").agg(F.count_if("is_a").alias("n_a"), F.count_if(~F.col("is_a")).alias("n_b"))
        .where((F.col("n_a") > 0) & (F.col("n_b") > 0)).orderBy((F.col("n_a").cast("double") * F.col("n_b")).desc(), "digest").limit(COMMON)
    )
    return [(r["digest"], r["n_a"], r["n_b"]) for r in top.collect()]


def _prefixes(model) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = model.value
        for pdf in batches:
            keys, hot_keys, hot = [], [], []
            for side, own, n_words, theta, digests, sizes in zip(pdf["side"], pdf["id"], pdf["n_words"], pdf["theta"], pdf["digests"], pdf["sizes"]):
                chunks = dict(zip(digests.tolist(), sizes.tolist()))
                joined = n_words >= SHARE * LONG  # such a class may be near to one of more than LONG words
                first = order.prefix(chunks, theta)
                keys.append([key for d in first if joined or d not in order.hot for key in order.keys(d, side, own & MASK)])
                hot_keys.append([key for d in first if not joined and d in order.hot for key in order.keys(d, side, own & MASK)])
                hot.append(n_words <= LONG and order.rests_on_hot(chunks, theta))
            yield pdf[["side", "id", "n_words", *SIGNED]].assign(keys=keys, hot_keys=hot_keys, hot=hot)

    return run


PREFIX_SCHEMA = "side string, id long, n_words int, " + ", ".join(f"{c} long" for c in SIGNED) + ", keys array<long>, hot_keys array<long>, hot boolean"


def at_least(lanes: np.ndarray, least: int) -> np.ndarray:
    """Bits that are set in ``least`` of the lanes (rows) or more, by carry-save addition."""
    planes, column = [], lanes
    while len(column):
        carried = []
        while len(column) > 2:
            n = len(column) // 3
            x, y, z = column[:n], column[n:2 * n], column[2 * n:3 * n]
            total, carry = x ^ y, x & y
            carry |= z & total
            total ^= z
            carried.append(carry)
            column = np.concatenate([total, column[3 * n:]]) if len(column) > 3 * n else total
        if len(column) == 2:
            carried.append(column[:1] & column[1:])
            column = column[:1] ^ column[1:]
        planes.append(column[0])
        column = (np.concatenate(carried) if len(carried) > 1 else carried[0]) if carried else ()
    if least >> len(planes):
        return np.zeros_like(planes[0])
    more, same = np.zeros_like(planes[0]), np.full_like(planes[0], MASK)
    for at in reversed(range(len(planes))):
        if least >> at & 1:
            same &= planes[at]
        else:
            more |= same & planes[at]
    return more | same


def _bitmaps(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(batch.column(c)) for c in SIGNED], axis=1).view(np.uint64)


def _bits(bitmaps: np.ndarray) -> np.ndarray:
    return np.unpackbits(bitmaps.view(np.uint8).reshape(len(bitmaps), -1), axis=1, bitorder="little")


class Lanes:
    """A block of training classes: a lane for each bit of the bitmaps, in it one bit for each class."""

    STRIP = 8_192

    def __init__(self, batches: list[pa.RecordBatch]):
        self.ids = np.concatenate([np.asarray(b.column("id")) for b in batches])
        self.n_words = np.concatenate([np.asarray(b.column("n_words")) for b in batches]).astype(np.int64)
        self.bitmaps = np.concatenate([_bitmaps(b) for b in batches])
        n = len(self.ids)
        self.bits = np.zeros((BITS, -(-n // 64)), np.uint64)
        packed, filled = self.bits.view(np.uint8), np.zeros(BITS)
        for start in range(0, n, self.STRIP):
            strip = _bits(self.bitmaps[start:start + self.STRIP])
            filled += strip.sum(axis=0)
            rows = np.packbits(strip.T, axis=1, bitorder="little")
            packed[:, start // 8:start // 8 + rows.shape[1]] = rows
        self.share = filled / n
        self.rarest = np.argsort(self.share, kind="stable")

    def near(self, n_words: int, bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Ids of the classes that are of like length and differ in few bits."""
        lanes = self.rarest[bits[self.rarest] > 0]
        spared = n_words - math.ceil(SHARE * n_words - 1e-9)  # a near class lacks no more words, hence no more bits
        others = np.cumsum(self.share[lanes])  # bits that any class has on average
        enough = np.flatnonzero(np.arange(1, len(lanes) + 1) - spared >= others + 4 * np.sqrt(others) + 1)
        lanes = lanes[:enough[0] + 1] if len(enough) else lanes
        found = []
        for start in range(0, self.bits.shape[1], TILE):
            hits = at_least(self.bits[lanes, start:start + TILE], max(1, len(lanes) - spared))
            words = np.flatnonzero(hits)
            if len(words):
                row, bit = np.nonzero(_bits(hits[words]))
                found.append((start + words[row]) * 64 + bit)
        if not found:
            return self.ids[:0]
        met = np.concatenate(found)
        n = self.n_words[met]
        need = np.ceil(SHARE * np.maximum(n, n_words) - 1e-9)
        differ = np.bitwise_count(self.bitmaps[met] ^ bitmap).sum(axis=1, dtype=np.int64)
        return self.ids[met[(np.minimum(n, n_words) >= need) & (differ <= n + n_words - 2 * need)]]


def _in_lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by cell, those of training first."""
    cell, waiting, lanes = None, [], None
    for batch in batches:
        cells, is_a = np.asarray(batch.column("cell")), batch.column("is_a").to_numpy(zero_copy_only=False).astype(bool)
        cuts = [0, *(np.flatnonzero((np.diff(cells) != 0) | (is_a[1:] != is_a[:-1])) + 1).tolist(), len(cells)]
        for start, stop in zip(cuts, cuts[1:]):
            if start == stop:
                continue
            part = batch.slice(start, stop - start)
            if cells[start] != cell:
                cell, waiting, lanes = cells[start], [], None
            if is_a[start]:
                waiting.append(part)
                continue
            if waiting:
                lanes, waiting = Lanes(waiting), []
            if lanes is None:
                continue
            ids, bitmaps, met = np.asarray(part.column("id")), _bitmaps(part), []
            for n_words, bitmap, bits in zip(part.column("n_words").to_pylist(), bitmaps, _bits(bitmaps)):
                met.append(lanes.near(n_words, bitmap, bits))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(met)), pa.array(np.repeat(ids, [len(m) for m in met]))], ["id_a", "id_b"])


def meetings(rows: DataFrame, keys: str) -> int:
    """Pairs of rows that a join by these keys lets meet."""
    is_a = F.col("side") == "train"
    met = rows.select(is_a.alias("is_a"), F.explode(keys).alias("key")).groupBy("key").agg((F.count_if("is_a") * F.count_if(~F.col("is_a"))).alias("n"))
    return met.agg(F.sum(F.col("n").cast("double"))).first()[0] or 0


def hot_candidates(rows: DataFrame) -> DataFrame | None:
    """id_a, id_b: pairs of classes of which hot chunks alone may hold enough words, and that differ in few bits.
    None where a join by the hot chunks is cheaper."""
    hot_keys = meetings(rows, "hot_keys")
    rows = rows.where("hot").withColumn("is_a", F.col("side") == "train")
    n = {r["is_a"]: r["count"] for r in rows.groupBy("is_a").count().collect()}
    if len(n) < 2 or n[True] * n[False] > LANES_PER_MEETING * hot_keys:
        return None
    n_i = -(-n[True] // LANE)
    n_j = max(-(-n[False] // LANE), min(-(-n[False] // LEAST_BLOCK), -(-TASKS // n_i)))
    own = F.xxhash64("id")
    first = F.when(F.col("is_a"), F.pmod(own, F.lit(n_i))).otherwise(F.lit(0))
    second = F.when(F.col("is_a"), F.lit(0)).otherwise(F.pmod(own, F.lit(n_j)))
    cells = F.when(
        F.col("is_a"), F.transform(F.sequence(F.lit(0), F.lit(n_j - 1)), lambda j: first * n_j + j)
    ).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n_i - 1)), lambda i: i * n_j + second))
    return (
        rows.select("is_a", "id", "n_words", *SIGNED, F.explode(cells.cast("array<int>")).alias("cell"))
        .repartitionById(n_i * n_j, F.col("cell")).sortWithinPartitions("cell", F.col("is_a").desc())
        .mapInArrow(_in_lanes, "id_a long, id_b long")
    )


def candidates(chunked: DataFrame, stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """id_a, id_b: pairs of classes that share a first chunk, or may share enough hot ones, and differ in few bits."""
    order = Order(common_chunks(chunked))
    rows = stage(chunked.mapInPandas(_prefixes(chunked.sparkSession.sparkContext.broadcast(order)), PREFIX_SCHEMA), "prefixes")

    hot = hot_candidates(rows) if order.hot else None
    keys = F.concat("keys", "hot_keys") if hot is None else F.col("keys")

    def of(side: str, mark: str) -> DataFrame:
        return rows.where(F.col("side") == side).select(
            F.col("id").alias(f"id_{mark}"), F.col("n_words").alias(f"n_{mark}"), *[F.col(c).alias(f"{c}_{mark}") for c in SIGNED], F.explode(keys).alias("key"),
        )

    longer = F.greatest("n_a", "n_b")
    need = F.ceil(F.lit(SHARE) * longer - F.lit(1e-9))
    differ = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in SIGNED), F.lit(0))
    a, b = of("train", "a"), of("eval", "b")
    met = a.join(b, "key").where((F.least("n_a", "n_b") >= need) & (differ <= F.col("n_a") + F.col("n_b") - 2 * need)).select("id_a", "id_b")
    return (met if hot is None else met.unionByName(hot)).distinct()


def _checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        kept = []
        for cls_a, cls_b, joined_a, joined_b in zip(pdf["cls_a"], pdf["cls_b"], pdf["words_a"], pdf["words_b"]):
            a, b = joined_a.split(" "), joined_b.split(" ")
            common = sum((Counter(a) & Counter(b)).values())
            if cls_a != cls_b and near(a, b, common):
                kept.append((cls_a, cls_b, common / max(len(a), len(b))))
        yield pd.DataFrame(kept, columns=["cls_a", "cls_b", "share"]).astype({"cls_a": object, "cls_b": object, "share": "float64"})


def near_classes(classes: DataFrame, stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """cls_a (train), cls_b (evaluation) of different classes with nearly the same statement."""
    is_a = F.col("side") == "train"
    own = F.conv(F.substring("cls", 1, 16), 16, -10).cast("long")
    texts_a = classes.where(is_a).select(own.alias("id_a"), F.col("cls").alias("cls_a"), F.col("words").alias("words_a"))
    texts_b = classes.where(~is_a).select(own.alias("id_b"), F.col("cls").alias("cls_b"), F.col("words").alias("words_b"))

    def checked(pairs: DataFrame, keys: list[str]) -> DataFrame:
        return pairs.join(texts_a, keys[0]).join(texts_b, keys[1]).mapInPandas(_checked, "cls_a string, cls_b string, share double")

    met = stage(candidates(stage(classes.mapInPandas(_chunked, CHUNK_SCHEMA), "chunks"), stage), "candidates")
    linked = stage(checked(met, ["id_a", "id_b"]), "linked").select("cls_a", "cls_b", "share")

    def nearest(mine: str, other: str) -> DataFrame:
        place = F.row_number().over(W.partitionBy(mine).orderBy(F.col("share").desc(), other))
        return linked.withColumn("place", place).where(F.col("place") <= CENTRES).select("cls_a", "cls_b")

    beside = nearest("cls_b", "cls_a").withColumnRenamed("cls_a", "via")
    met_again = nearest("cls_a", "cls_b").join(beside, "cls_b").where("cls_a <> via").select("cls_a", "via").distinct()
    more = (
        met_again.join(linked.select(F.col("cls_a").alias("via"), "cls_b"), "via").select("cls_a", "cls_b").distinct()
        .join(linked.select("cls_a", "cls_b"), ["cls_a", "cls_b"], "left_anti")
    )
    return linked.select("cls_a", "cls_b").unionByName(checked(more, ["cls_a", "cls_b"]).select("cls_a", "cls_b"))


def overlaps(records: DataFrame, stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """item_train, item_eval of all pairs; ``records`` as for :func:`with_classes`."""
    rows = stage(with_classes(records), "records")
    is_a = F.col("side") == "train"
    train, held_out = rows.where(is_a), rows.where(~is_a)

    def by(key: str) -> DataFrame:
        return train.where(F.col(key).isNotNull()).select(key, F.col("item_no").alias("item_train")).join(
            held_out.where(F.col(key).isNotNull()).select(key, F.col("item_no").alias("item_eval")), key
        ).select("item_train", "item_eval")

    classes = stage(
        rows.where(F.col("cls").isNotNull()).groupBy("side", "cls").agg(F.first("n_words").alias("n_words"), F.first("words").alias("words")), "classes"
    )
    near = stage(near_classes(classes, stage), "near")
    members_a = train.where(F.col("cls").isNotNull()).select(F.col("cls").alias("cls_a"), F.col("item_no").alias("item_train"))
    members_b = held_out.where(F.col("cls").isNotNull()).select(F.col("cls").alias("cls_b"), F.col("item_no").alias("item_eval"))
    expanded = near.join(members_a, "cls_a").join(members_b, "cls_b").select("item_train", "item_eval")
    return by("task_key").unionByName(by("hash_key")).unionByName(by("cls")).unionByName(expanded).distinct()


def counts(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs and records concerned, for each evaluation split and source."""
    held_out = records.where(F.col("side") != "train").select(F.col("item_no").alias("item_eval"), "split", "source")
    return (
        pairs.groupBy("item_eval").agg(F.count(F.lit(1)).alias("n"))
        .join(held_out, "item_eval").groupBy("split", "source")
        .agg(F.sum("n").alias("n_pairs"), F.count(F.lit(1)).alias("n_records"))
    )
