"""Text values that break off before their end.

A *backward character n-gram model* compares two explanations of a value's final
context: that whole texts end so, and that a text was cut there. Read backwards,
the context starts with the state the text is in at its end (inside a code fence,
a think tag, brackets or a statement; prose, code or JSON) and goes on with its
last characters. Each longer context is drawn to the shorter one by ``PULL``
examples; contexts seen less than ``MIN_COUNT`` times are not used. The log-odds
are held against a threshold for each language and column.

*Fit.* One map-only pass takes the end of every value and one random inner
position of it; both are counted over all rows in a distributed aggregation, and
the ``MODEL_ROWS`` most frequent contexts are kept. Flags, which are wrong here,
are not used as labels: values whose end is in a state that cuts are mostly in
are left out of the ends of the second count, unless their last characters are an
ending that recurs. Thresholds are those of least error over all ends and cuts of
a language and column, each end judged without its own count.

An exact check follows: an end in a replacement character, an ellipsis, a lone
backslash or half a fence is cut.

Defined results: null, empty and blank values are no cases; a value that merely
does not parse but is complete is whole; trailing blanks do not matter; repeated
rows are judged each; a state never seen is judged by what is open in it; a table
without values gives no rows.
"""

from __future__ import annotations

import ast
import codeop
import json
import math
import random
import re
import warnings
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

ORDERS = (1, 2, 3, 4, 5, 7, 9, 12)
MIN_COUNT = 5
PULL = 5.0
MODEL_ROWS = 200_000
#: An ending of so many last characters that recurs in so many values is one, whatever its state.
RECURRING = (12, 9)
RECURS = 8
CUT_COST = 3
GRID = [x / 4 for x in range(-8, 9)]
#: Function words that tell natural languages apart.
FUNCTION_WORDS = {
    "en": {"the", "is", "of", "to", "and", "a", "in", "for", "not", "i"}, "de": {"der", "die", "das", "und", "ist", "nicht", "ein", "zu", "mit", "ich"},
    "fr": {"le", "la", "les", "et", "est", "de", "des", "une", "pas", "je"}, "es": {"el", "los", "las", "y", "es", "de", "una", "no", "que", "se"},
}
_OPEN = ",-–('’<=+/&_"
CODE_START = re.compile(r"(?:#[^\n]*\n\s*)*(?:from \w|import \w|def \w|class \w|@\w|if __name__|async def|#include|package \w|func \w|fn \w|function \w|public |using |#!|let |const )")
#: A paragraph of words: a capital, then three more words without code signs.
_PROSE = re.compile(r"[A-ZÀ-Þ][\w'’-]*,?(?: [\w'’,-]+){2}[^=(){}\[\]:]*(?:[.…]|$)")
_JSON_START = re.compile(r"[{\[]\s*[\"'{\[}]")
_DIGITS = re.compile(r"\d")
_FENCE_TAG = re.compile(r"[^\n]*\n?")
_INVISIBLE = "​‌‍⁠﻿­ \t\r\n\f\v "


def final_part(text: str) -> tuple[str, str, str]:
    """(form, state, part): what kind of text the last part is, what is open."""
    fence = text.count("```") & 1
    at = text.rfind("```")
    think = text.rfind("<think>") > text.rfind("</think>")
    if fence:
        part = _FENCE_TAG.sub("", text[at + 3:], count=1)
    else:
        start = at + 3 if at >= 0 else 0
        close = text.rfind("</think>")
        part = text[max(start, close + 8 if close >= 0 else 0):]
    body = part.lstrip()
    if not body:
        return "closed", f"{fence}{int(think)}", part
    json_at = _JSON_START.search(body)
    if CODE_START.match(body):
        form, inner = "code", body
    elif json_at and (json_at.start() == 0 or body[:json_at.start()].rstrip()[-1:] in ":.\n!"):
        inner = body[json_at.start():]
        form = "json"
    else:
        form, inner = "prose", body
    if form == "code" and not fence:
        last = body.rstrip().rsplit("\n\n", 1)
        if len(last) == 2 and _PROSE.match(last[1]):
            return "prose", f"{fence}{int(think)}0", last[1]
    depth = 0
    if form != "prose":
        depth = inner.count("(") + inner.count("[") + inner.count("{") - inner.count(")") - inner.count("]") - inner.count("}")
        if form == "json" and depth <= 0 and re.search(r"[A-Za-zÀ-ÿ]{3}", tail := inner[inner.rfind("}") + 1:]):
            form, depth, body = "prose", 0, tail.lstrip()
            return form, f"{fence}{int(think)}0", body
    return form, f"{fence}{int(think)}{int(depth > 0)}", part


_LETTERS = re.compile(r"[^\W\d_]+")
_TELLS = {word: [lang for lang, words in FUNCTION_WORDS.items() if word in words] for words in FUNCTION_WORDS.values() for word in words}


def language_of(prose: str) -> str:
    """The natural language with most function words, ``none`` without any."""
    found = Counter(lang for word in _LETTERS.findall(prose.casefold()) for lang in _TELLS.get(word, ()))
    return max(FUNCTION_WORDS, key=lambda lang: found[lang]) if found else "none"


def end_features(text: str) -> tuple[str, str, str]:
    """(language, state, last characters) of the end of a text without trailing blanks."""
    form, state, part = final_part(text)
    last = part.rstrip()[-1:]
    if form == "closed":
        language, seen = "closed", "o" if "1" in state and re.search(r"\w", text.rsplit("```", 1)[0].rsplit("<think>", 1)[0]) else "s"
    elif form == "json":
        language, seen = "json", "o"
        if last and last in "}]":
            try:
                json.loads(part)
                state, seen = state[:2] + "0", "s"
            except ValueError:
                seen = "b"
    elif form == "code":
        unfinished = unfinished_code(part.strip("\n"))
        language = "code" if unfinished is None else "python"
        seen = "o" if unfinished or unfinished is None and last not in "};)" else "s"
    else:
        language, seen = language_of(part), "n" if last.isdigit() else "o" if last.isalnum() or last in _OPEN else "s"
    return language, f"{form}{state}{seen}", _DIGITS.sub("9", text[-max(ORDERS):])


def random_cut(text: str) -> str:
    """The text up to an inner position that depends on the text only."""
    return text[:random.Random(zlib.crc32(text.encode("utf-8", "replace"))).randrange(1, len(text))].rstrip(_INVISIBLE)


def root_of(state: str) -> str:
    """What is open in a state, the shortest context of all."""
    return "open" if "1" in state or state[-1] == "o" else "number" if state[-1] == "n" else "shut"


def contexts(state: str, tail: str, orders: Iterable[int] = ORDERS) -> list[str]:
    """Context keys of an end, shortest first."""
    return [root_of(state), state, *[f"{state}|{tail[-n:]}" for n in orders]]


class EndModel:
    """Counts of contexts at ends and at cuts, the recurring endings, and thresholds."""

    def __init__(self, first: dict[str, tuple[int, int]]):
        self.first = self.counts = first
        self.weight = self._weight(first)
        self.first_weight = self.weight
        self.thresholds: dict[tuple[str, str], float] = {}

    @staticmethod
    def _weight(counts: dict[str, tuple[int, int]]) -> float:
        roots = [counts.get(r, (0, 0)) for r in ("open", "number", "shut")]
        return (sum(c for _, c in roots) + 1) / (sum(e for e, _ in roots) + 1)

    def refit(self, counts: dict[str, tuple[int, int]]) -> None:
        self.counts, self.weight = counts, self._weight(counts)

    def _share(self, counts: dict[str, tuple[int, int]], weight: float, state: str, own: int) -> float:
        share = 0.5
        for key, pull in ((root_of(state), 1.0), (state, PULL)):
            ends, cuts = counts.get(key, (0, 0))
            ends = max(0, ends - own) * weight
            share = (ends + pull * share) / (ends + cuts + pull)
        return share

    def kept(self, state: str, tail: str) -> bool:
        """Whether an end counts as one, by the first counts."""
        if self._share(self.first, self.first_weight, state, 1) > 0.378:
            return True
        for n in RECURRING:
            ends, cuts = self.first.get(f"{state}|{tail[-n:]}", (0, 0))
            if ends > RECURS and ends * self.first_weight > 4 * cuts:
                return True
        return False

    def log_odds(self, state: str, tail: str, own: int = 0) -> float:
        share = self._share(self.counts, self.weight, state, own)
        for n in ORDERS:
            ends, cuts = self.counts.get(f"{state}|{tail[-n:]}", (0, 0))
            ends -= own
            if ends + cuts < MIN_COUNT:
                break
            share = (ends * self.weight + PULL * share) / (ends * self.weight + cuts + PULL)
        share = min(max(share, 1e-6), 1 - 1e-6)
        return math.log(share / (1 - share))

    def end_odds(self, state: str, tail: str) -> float:
        """Log-odds of a row that may have been counted itself."""
        return self.log_odds(state, tail, int(self.kept(state, tail)))

    def calibrate(self, examples: Iterable[tuple[str, str, bool, float, int]]) -> None:
        """Thresholds of least error from (column, language, is an end, log-odds in quarters, number)."""
        held: dict[tuple[str, str], list[tuple[bool, float, int]]] = {}
        for tab, language, is_end, odds, n in examples:
            held.setdefault((tab, language), []).append((is_end, odds, n))
        for at, found in held.items():
            self.thresholds[at] = min(
                GRID, key=lambda t: (sum(n * (CUT_COST if is_end else 1) for is_end, odds, n in found if (odds < t) == is_end), abs(t))
            )

    def is_cut(self, tab: str, language: str, state: str, tail: str) -> bool:
        return self.end_odds(state, tail) < self.thresholds.get((tab, language), 0.0)


def quarter(odds: float) -> float:
    return math.floor(odds * 4) / 4


def fit(texts: Iterable[str], tab: str = "") -> EndModel:
    """The same fit for texts that are at hand."""
    ends, cuts = [], []
    for text in texts:
        text = text.rstrip(_INVISIBLE)
        if len(text) > 1:
            ends.append(end_features(text))
            piece = random_cut(text)
            if piece:
                cuts.append(end_features(piece))

    def count(kept: list[tuple[str, str, str]], orders: Iterable[int]) -> dict[str, tuple[int, int]]:
        e = Counter(key for _, s, t in kept for key in contexts(s, t, orders))
        c = Counter(key for _, s, t in cuts for key in contexts(s, t, orders))
        return {key: (e[key], c[key]) for key in e.keys() | c.keys()}

    model = EndModel(count(ends, RECURRING))
    kept = [x for x in ends if model.kept(*x[1:])]
    model.refit(count(kept, ORDERS))
    model.calibrate([(tab, lang, True, quarter(model.end_odds(s, t)), 1) for lang, s, t in kept] + [(tab, lang, False, quarter(model.log_odds(s, t)), 1) for lang, s, t in cuts])
    return model


_HALF_FENCE = re.compile(r"\n`{1,2}$")
_LINE_NOTE = re.compile(r"(?m)^\s*#.*$")
_NAME_END = re.compile(r"(?<![\w.])([A-Za-z_]\w*)$")
_KNOWN = {"None", "True", "False", "self", "pass", "break", "continue"}


def _attempt(code: str) -> str:
    """whole, open (the parser reads all of it and then misses more) or faulty."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(code, "f", "exec", codeop.PyCF_ALLOW_INCOMPLETE_INPUT | ast.PyCF_ONLY_AST)
        return "whole"
    except SyntaxError as error:
        message = str(error.msg)
        if "incomplete input" in message:
            return "open"
        return "string" if re.match(r"unterminated (?:f-)?string", message) and error.lineno == code.count("\n") + 1 else "faulty"
    except (ValueError, RecursionError, MemoryError):
        return "faulty"


def _parses(code: str) -> bool:
    return _attempt(code) == "whole"


def unfinished_code(code: str) -> bool | None:
    """Whether Python code stops inside a statement; None if it is not Python."""
    first = _attempt(code)
    if first == "whole":
        last = _NAME_END.search(code)
        return bool(last and last[1] not in _KNOWN and len(re.findall(rf"\b{last[1]}\b", code)) == 1)
    if first == "open":
        return True
    # Python up to the statement in which it stops
    lines = code.split("\n")
    for drop in range(1, min(len(lines), 8) + 1):
        head = "\n".join(lines[:len(lines) - drop])
        if not _LINE_NOTE.sub("", head).strip():
            if drop == len(lines) and len(lines) <= 2 and re.match(r"\s*(?:def|class|from|import|@)\b", code) and not re.search(r"[{;]\s*$", code):
                return True
            break
        if _parses(head) or _parses(head + "\n" + " " * (len(lines[len(lines) - drop]) - len(lines[len(lines) - drop].lstrip()) or 4) + "pass"):
            return True
    # a string open in the last line, in a statement that began anywhere before
    return True if first == "string" and _attempt(code.rpartition("\n")[0]) == "open" else None


def broken_mark(text: str) -> bool:
    """Whether a text without trailing blanks ends in a sign of a break."""
    return text[-1] in "�…\\" or text.endswith("...") or _HALF_FENCE.search(text) is not None


def is_cut(text: str, model: EndModel, tab: str = "") -> bool:
    """Whether a value breaks off before its end."""
    text = text.rstrip(_INVISIBLE)
    return bool(text) and (broken_mark(text) or model.is_cut(tab, *end_features(text)))


FEATURES = ["language", "state", "tail", "mark", "cut_language", "cut_state", "cut_tail"]
FEATURE_SCHEMA = "tab string, key_ long, group_ string, language string, state string, tail string, mark boolean, cut_language string, cut_state string, cut_tail string"


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text in pdf["text_"]:
            text = text.rstrip(_INVISIBLE)
            if not text:
                rows.append((None, None, None, False, None, None, None))
                continue
            piece = random_cut(text) if len(text) > 1 else ""
            rows.append((*end_features(text), broken_mark(text), *(end_features(piece) if piece else (None, None, None))))
        yield pd.concat([pdf[["tab", "key_", "group_"]].reset_index(drop=True), pd.DataFrame(rows, columns=FEATURES).astype({"mark": bool})], axis=1)


def features(df: DataFrame, tab: str, key: str, text: str, group: str | None = None) -> DataFrame:
    """The end of every value that is not blank, and of a random cut of it (map-only)."""
    shown = F.col(group).cast("string") if group else F.lit(None).cast("string")
    picked = df.select(F.lit(tab).alias("tab"), F.col(key).cast("long").alias("key_"), shown.alias("group_"), F.col(text).alias("text_"))
    return picked.where(F.col("text_").rlike(r"\S")).mapInPandas(_features, FEATURE_SCHEMA)


def _counted(rows: DataFrame, is_end: Column, orders: Iterable[int]) -> dict[str, tuple[int, int]]:
    """Contexts at ends and cuts over all rows, the most frequent ones."""
    def keys(state: str, tail: str) -> Column:
        at = F.col(state)
        root = F.when(F.contains(at, F.lit("1")) | at.endswith("o"), "open").when(at.endswith("n"), "number").otherwise("shut")
        return F.explode(F.array(root, at, *[F.concat(at, F.lit("|"), F.right(F.col(tail), F.lit(n))) for n in orders])).alias("key")

    ends = rows.where(is_end).select(keys("state", "tail"), F.lit(1).alias("e"), F.lit(0).alias("c"))
    cuts = rows.where("cut_state is not null").select(keys("cut_state", "cut_tail"), F.lit(0).alias("e"), F.lit(1).alias("c"))
    counted = (
        ends.unionByName(cuts).groupBy("key").agg(F.sum("e").alias("e"), F.sum("c").alias("c"))
        .where((F.col("e") + F.col("c") >= MIN_COUNT) | ~F.contains("key", F.lit("|"))).orderBy((F.col("e") + F.col("c")).desc(), "key").limit(MODEL_ROWS)
    )
    return {r["key"]: (r["e"], r["c"]) for r in counted.collect()}


def _shared(model: EndModel, rows: DataFrame, returns: str, of: Callable) -> Callable[..., Column]:
    """A column function over the features, with the model sent to all tasks."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(returns)
    def run(tab: pd.Series, language: pd.Series, state: pd.Series, tail: pd.Series) -> pd.Series:
        own = held.value
        return pd.Series([of(own, *x) for x in zip(tab, language, state, tail)])

    return run


def learn(rows: DataFrame) -> EndModel:
    """The model from staged features of all columns; only counts leave the executors."""
    whole = F.col("state").isNotNull()
    model = EndModel(_counted(rows, whole, RECURRING))
    is_kept = _shared(model, rows, "boolean", lambda m, _, __, s, t: m.kept(s, t))("tab", "language", "state", "tail")
    model.refit(_counted(rows.where(whole).withColumn("kept_", is_kept), F.col("kept_"), ORDERS))
    kept_odds = _shared(model, rows, "double", lambda m, _, __, s, t: quarter(m.log_odds(s, t, 1)) if m.kept(s, t) else None)
    cut_odds = _shared(model, rows, "double", lambda m, _, __, s, t: quarter(m.log_odds(s, t)))
    ends = rows.where(whole).select("tab", "language", F.lit(True).alias("is_end"), kept_odds("tab", "language", "state", "tail").alias("odds")).where("odds is not null")
    cuts = rows.where("cut_state is not null").select("tab", F.col("cut_language").alias("language"), F.lit(False).alias("is_end"), cut_odds("tab", "cut_language", "cut_state", "cut_tail").alias("odds"))
    bins = ends.unionByName(cuts).groupBy("tab", "language", "is_end", "odds").agg(F.count(F.lit(1)).alias("n"))
    model.calibrate([tuple(r) for r in bins.select("tab", "language", "is_end", "odds", "n").collect()])
    return model


def judged(rows: DataFrame, model: EndModel) -> DataFrame:
    """tab, key_, group_, cut_ of staged features."""
    cut = _shared(model, rows, "boolean", lambda m, *x: m.is_cut(*x))
    return rows.where("state is not null").select("tab", "key_", "group_", (F.col("mark") | cut("tab", "language", "state", "tail")).alias("cut_"))


def scored_tables(tables: dict[str, DataFrame], stage: Callable[[DataFrame, str], DataFrame], key: str = "record_id", text: str = "raw_response", group: str = "model") -> DataFrame:
    """tab, key_, group_, cut_ of several tables: one model, thresholds for each column and language."""
    out = None
    for name, df in tables.items():
        part = features(df, name, key, text, group)
        out = part if out is None else out.unionByName(part)
    rows = stage(out, "ends")
    return judged(rows, learn(rows))


def rates(scored: DataFrame) -> DataFrame:
    """Share of cut values for each source."""
    return scored.groupBy("tab", F.col("group_").alias("model")).agg(
        F.count(F.lit(1)).alias("n_values"), F.count_if("cut_").alias("n_cut"),
        F.bround(F.count_if("cut_") / F.count(F.lit(1)), 6).alias("rate"),
    )
