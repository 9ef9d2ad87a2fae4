"""Natural language of short texts by character n-gram naive Bayes.

Byte trigrams are hashed into a fixed number of buckets; a batch of texts is
scored with a few array operations. The model is fitted on all labelled rows: each
task counts buckets for each language, and only the sums, of fixed number, reach
the driver. Labels may be wrong, missing or spelled in capitals; only the
languages named are kept and a few wrong labels do not move the counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

LANGUAGES = ("en", "de", "fr", "es")
BUCKETS = 1 << 15
_CODE_LINE = re.compile(r"^.*(?:[(){}\[\]=;_]|->|::|\d{4}-\d\d-\d\d).*$", re.M)
_FENCED = re.compile(r"```.*?(?:```|\Z)", re.S)


def prose_only(text: str) -> str:
    """A document without fenced code and without lines that look like code or logs."""
    return _CODE_LINE.sub("", _FENCED.sub("\n", text))


def trigram_buckets(data: bytes) -> np.ndarray:
    """Bucket of every byte trigram."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    if b.size < 3:
        return np.zeros(0, dtype=np.int64)
    mixed = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    mixed ^= mixed >> np.uint32(15)
    return (mixed % np.uint32(BUCKETS)).astype(np.int64)


class LanguageModel:
    """Log-likelihoods of the buckets in each language."""

    def __init__(self, table: np.ndarray):
        self.table = table  # (BUCKETS, languages)

    @classmethod
    def fit(cls, samples: dict[str, list[str]]) -> LanguageModel:
        table = np.zeros((BUCKETS, len(LANGUAGES)))
        for i, language in enumerate(LANGUAGES):
            joined = "\n\n".join(prose_only(t) for t in samples.get(language, ())).lower().encode()
            table[:, i] = np.bincount(trigram_buckets(joined), minlength=BUCKETS)
        return cls.of_counts(table)

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> LanguageModel:
        """From (BUCKETS, languages) counts; each bucket counts half a time more."""
        smooth = counts + 0.5
        return cls(np.log(smooth / smooth.sum(axis=0)).astype(np.float32))

    def scores(self, texts: list[str]) -> np.ndarray:
        """(texts, languages) log-likelihoods; zeros for texts below three bytes."""
        encoded = [t.lower().encode("utf-8", "replace") for t in texts]
        out = np.zeros((len(texts), len(LANGUAGES)))
        if not texts:
            return out
        sizes = np.array([max(0, len(e) - 2) for e in encoded])
        used = np.flatnonzero(sizes)
        if not used.size:
            return out
        pieces = [trigram_buckets(encoded[i]) for i in used] if used.size < 8 else None
        if pieces is None:
            joined = b"".join(encoded[i] for i in used)
            lengths = np.array([len(encoded[i]) for i in used])
            rows = self.table[np.append(trigram_buckets(joined), [0, 0])]
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            cum = np.vstack([np.zeros((1, len(LANGUAGES))), np.cumsum(rows, axis=0, dtype=np.float64)])
            out[used] = cum[starts + lengths - 2] - cum[starts]
        else:
            for i, piece in zip(used, pieces):
                out[i] = self.table[piece].sum(axis=0)
        return out


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    totals = np.zeros((len(LANGUAGES), BUCKETS), dtype=np.int64)
    for pdf in batches:
        for i, language in enumerate(LANGUAGES):
            joined = "\n\n".join(prose_only(t) for t in pdf["text"][pdf["lang"] == language]).lower().encode("utf-8", "replace")
            totals[i] += np.bincount(trigram_buckets(joined), minlength=BUCKETS)
    at = np.nonzero(totals)
    yield pd.DataFrame({"language": at[0].astype("int32"), "bucket": at[1].astype("int32"), "n": totals[at]})


def fit_from(df: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fit on all labelled rows."""
    label = F.lower(F.trim(F.col(lang)))
    rows = df.where(label.isin(*LANGUAGES) & F.col(text).isNotNull()).select(label.alias("lang"), F.col(text).alias("text"))
    counts = np.zeros((BUCKETS, len(LANGUAGES)))
    for row in rows.mapInPandas(_counted, "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"], row["language"]] = row["n"]
    return LanguageModel.of_counts(counts)
