"""Defective pairs of a question and its answer.

An answer is ``raw_response``, or ``code`` where the response holds no content;
the question is that of its task. Each defective answer gets one defect:

* ``empty``: neither field holds content beyond blanks, invisible characters,
  bare fences and bare think tags;
* ``refusal``: it declines, in prose, comment or stub: a trigram naive Bayes model
  of sentences, bootstrapped from the ways to decline in ``REFUSAL`` against the
  questions and all other answers without code, with a threshold of least error;
* ``copied``: it only holds text of the question;
* ``truncated``: it breaks off (:mod:`sparloom.llm.truncation`);
* ``language``: the language posteriors of its prose or comments, by character
  n-gram naive Bayes (:mod:`sparloom.llm.langid`), differ from the question's,
  or its code is not Python.

One map-only stage reads the answers and leaves a slim row each: a defect that
shows without the question, its language scores, and the answer's text only
where it has no Python code and might be copied. Slim rows meet the questions'
languages on the task; the few texts meet the questions' texts. One hot task is
no burden, because what is exchanged per answer is some tens of bytes, and the
join is left to adaptive skew handling.

Defined results: a null response is no defect if code is there; a filled
``generation_issue`` alone is none either; an answer to a task without a
question is held against English; of several questions of a task the languages
of all count, and being copied from any counts; an answer without prose or
comments has no natural language; repeated rows count each; empty tables give
no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sparloom.llm.langid import BUCKETS, LANGUAGES, LanguageModel, trigram_buckets
from sparloom.llm.truncation import CODE_START, EndModel, _parses, is_cut, unfinished_code

#: Log-likelihood margin by which another language must win.
MARGIN = 12.0
MIN_LETTERS = 24
COPY_SHARE = 0.8
COPY_OF_QUESTION = 0.5
_NOTHING = re.compile(r"```[\w+-]*|</?think>|[\s​‌‍⁠﻿­᠎⁡-⁤ㅤ]+")
_THINK = re.compile(r"<think>.*?(?:</think>|\Z)", re.S)
_FENCE = re.compile(r"```([\w+#-]*)[^\n]*\n(.*?)(?:```|\Z)", re.S)
#: Two slashes behind code divide in Python; at the start of a line they are a comment of other languages.
_LINE_COMMENT = re.compile(r"(?m)(?:(?:^|[ \t])#|^[ \t]*//)[ \t]+(.*)$")
_DOC = re.compile(r"(?:\"\"\"|''')(.*?)(?:\"\"\"|'''|\Z)", re.S)
_FOREIGN = re.compile(r"[{;][ \t]*$|^\s*(?:end|fi|done|esac)\s*$|^\s*(?:package|func|fn|public|#include|using|let|const|var)\b", re.M)
_QUOTE_MARK = re.compile(r"(?m)^[ \t]*(?:>+|#+|//+|\*|\"\"\"|''')[ \t]?")
_WORDS = re.compile(r"[^\W_]+")
#: Ways to decline, without regard to case; they are seeds of the model, not the verdict.
REFUSAL = re.compile(
    r"\b(?:i|we)(?:\s+am|['’]m|\s+are|['’]re)?\s+(?:not\s+(?:able|allowed|permitted|going|willing)\s+to|unable\s+to|forbidden\s+to)"
    r"|\b(?:i|we)\s+(?:can(?:no|['’])t|can\s?not|won['’]?t|will\s+not|must\s+(?:decline|refuse)|have\s+to\s+(?:pass|decline|refuse)|decline|refuse|would\s+rather\s+not|['’]d\s+rather\s+not|do\s+not\s+feel\s+comfortable)"
    r"|\bnot\s+possible\s+for\s+(?:me|us)\b|\bno\s+(?:implementation|solution|code|answer)\s+(?:will|can)\s+be\s+(?:given|provided|written)"
    r"|\b(?:goes\s+)?against\s+(?:my|our)\s+(?:guidelines|policy|policies|rules)|\b(?:outside|beyond)\s+(?:of\s+)?what\s+(?:i|we)\s+can\s+do"
    r"|\bas\s+an\s+ai\b|\blo\s+siento,?\s+(?:pero\s+)?no\s+puedo|\bno\s+puedo\s+(?:ayudar|resolver|escribir)|\bich\s+kann\s+(?:das|dabei|diese|dieses|hier)\b.{0,40}\bnicht|\bje\s+ne\s+(?:peux|vais)\s+pas",
    re.I,
)


def has_content(text: str | None) -> bool:
    return bool(text) and bool(_NOTHING.sub("", text))


def split_answer(text: str) -> tuple[str, str, str]:
    """(prose, code, rest) of an answer: text outside fences, code inside, think part."""
    think = " ".join(m.group()[7:].removesuffix("</think>") for m in _THINK.finditer(text))
    body = _THINK.sub("\n", text)
    code = "\n\n".join(m.group(2) for m in _FENCE.finditer(body))
    outside = _FENCE.sub("\n", body)
    if CODE_START.match(outside.lstrip()):
        keep = []
        for block in re.split(r"\n\s*\n", outside.strip("\n")):
            if re.match(r"[A-ZÀ-Þ¿¡][\w'’-]*,?(?: [\w'’,-]+){2}[^=(){}\[\]]*(?:[.…:]|$)", block.strip()) and not block.startswith((" ", "\t")):
                keep.append(block)
            else:
                code += "\n\n" + block
        outside = "\n\n".join(keep)
    return outside, code.strip("\n"), think


def comments_of(code: str) -> str:
    found = [m.group(1) for m in _LINE_COMMENT.finditer(code)] + [m.group(1) for m in _DOC.finditer(code)]
    return " ".join(found)


def is_python(code: str) -> bool:
    """Whether code is Python, also where it stops inside a statement or several
    blocks follow each other."""
    if not _FOREIGN.search(code):
        return True
    return _parses(code) or unfinished_code(code) is not None


_STUB = re.compile(r"^(?:\s*(?:def|class|async def)\b.*|\s*(?:pass|\.\.\.|return(?:\s+(?:None|0|-1|\"\"|''|\[\]|\{\}))?|raise\s+\w+.*|import .*|from .*|#.*|print\(.*\)|if __name__.*|\w+\(\))\s*|\s*\"\"\".*|\s*)$")


def is_stub(code: str) -> bool:
    """Code that does nothing: signatures, comments, pass, raise, bare returns."""
    return all(_STUB.match(line) for line in _DOC.sub("", code).split("\n"))


def classify(text: str, model: EndModel) -> tuple[str | None, str, str, bool]:
    """(defect that shows without the question, prose, comments, maybe copied)."""
    prose, code, think = split_answer(text)
    comments = comments_of(code)
    body = _NOTHING.sub(" ", prose).strip()
    only_words = not code.strip() or not _DOC.sub("", _LINE_COMMENT.sub("", code)).strip() or is_stub(code)
    if not CODE_START.match(code.lstrip()) and code.strip() and not _FOREIGN.search(code) and not _parses(code):
        only_words, body, code, comments = True, body + " " + code, "", ""
    said = f"{body}\n{comments}\n{code if code and only_words else ''}"
    if code.strip() and not only_words and not is_python(code):
        return "language", "", "", False
    maybe_copied = only_words and bool(_WORDS.search(said))
    cut = is_cut(text, model)
    return ("truncated" if cut else None), f"{body} {think}", comments, maybe_copied


SLIM_SCHEMA = "record_id long, task_id string, defect string, prose array<double>, comments array<double>, text string, seed boolean"


def slim(records: DataFrame, ends: EndModel, languages: LanguageModel) -> DataFrame:
    """One slim row for each answer (map-only)."""
    shared = records.sparkSession.sparkContext.broadcast((ends, languages))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, lang = shared.value
        for pdf in batches:
            defects, prose, comments, texts, seeds = [], [], [], [], []
            for response, code in zip(pdf["raw_response"], pdf["code"]):
                response = response if isinstance(response, str) else None
                code = code if isinstance(code, str) else None
                text = response if has_content(response) else code if has_content(code) else None
                seed = False
                if text is None:
                    defect, p, c, maybe = "empty", "", "", False
                else:
                    defect, p, c, maybe = classify(text, own)
                    seed = maybe and REFUSAL.search(text) is not None
                    if text is response and maybe and not seed and has_content(code):
                        other = split_answer(code)[1] or code
                        if CODE_START.match(other.lstrip()) and not is_stub(other):
                            # the code was taken from a part of the response that is missing now
                            maybe, defect = False, "truncated" if defect is None else defect
                defects.append(defect)
                prose.append(p if len(p) >= MIN_LETTERS else "")
                comments.append(c if len(c) >= MIN_LETTERS else "")
                texts.append(text if maybe else None)
                seeds.append(seed)
            sp, sc = lang.scores(prose), lang.scores(comments)
            yield pd.DataFrame({
                "record_id": pdf["record_id"], "task_id": pdf["task_id"], "defect": defects,
                "prose": [r if r.any() else None for r in sp], "comments": [r if r.any() else None for r in sc], "text": texts, "seed": seeds,
            })

    return records.select("record_id", "task_id", "raw_response", "code").mapInPandas(run, SLIM_SCHEMA)


_SENTENCE = re.compile(r"[.!?\n]+")
REFUSAL_GRID = [x / 2 for x in range(-20, 41)]


def sentences(text: str) -> list[str]:
    """Parts of a text with words, quote and comment marks aside."""
    return [part.strip().lower() for part in _SENTENCE.split(_QUOTE_MARK.sub("", text)) if _WORDS.search(part)]


def _refusal_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trigram buckets of sentences that decline (side 1) and of all others in texts that hold none."""
    totals = np.zeros((2, BUCKETS), dtype=np.int64)
    for pdf in batches:
        held: tuple[list[str], list[str]] = ([], [])
        for text, seed in zip(pdf["text"], pdf["seed"]):
            for sentence in sentences(text):
                if not seed or REFUSAL.search(sentence):
                    held[int(seed)].append(sentence)
        for side in (0, 1):
            totals[side] += np.bincount(trigram_buckets("\n\n".join(held[side]).encode("utf-8", "replace")), minlength=BUCKETS)
    at = np.nonzero(totals)
    yield pd.DataFrame({"side": at[0].astype("int32"), "bucket": at[1].astype("int32"), "n": totals[at]})


class RefusalModel:
    """Log-odds of trigrams in sentences that decline, and the threshold."""

    def __init__(self, counts: np.ndarray):
        smooth = counts + 0.5
        self.odds = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())
        self.threshold = float("inf")

    def score(self, text: str) -> float:
        """Log-odds of the sentence that declines most, per square root of its length."""
        best = -99.0
        for sentence in sentences(text):
            buckets = trigram_buckets(sentence.encode("utf-8", "replace"))
            if len(buckets):
                best = max(best, float(self.odds[buckets].sum()) / len(buckets) ** 0.5)
        return best

    def calibrate(self, bins: list[tuple[bool, float, int]]) -> None:
        """Least error between seeds and others; without a seed nothing declines."""
        if any(seed for seed, _, _ in bins):
            self.threshold = min(REFUSAL_GRID, key=lambda t: (sum(n for seed, odds, n in bins if (odds >= t) != seed), abs(t)))


def refusals(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """record_id of answers without code that decline. Only sums over all texts reach the driver."""
    texts = rows.where(F.col("text").isNotNull()).select("record_id", "text", "seed")
    learned = texts.select("text", "seed").unionByName(asked.select(F.col("question").alias("text"), F.lit(False).alias("seed")))
    counts = np.zeros((2, BUCKETS))
    for row in learned.mapInPandas(_refusal_counts, "side int, bucket int, n long").groupBy("side", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["side"], row["bucket"]] = row["n"]
    model = RefusalModel(counts)

    def scored(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf[["record_id", "seed"]].assign(odds=[shared.value.score(t) for t in pdf["text"]])

        return texts.mapInPandas(run, "record_id long, seed boolean, odds double")

    odds = scored(rows.sparkSession.sparkContext.broadcast(model))
    bins = odds.groupBy("seed", (F.floor(F.col("odds") * 2) / 2).alias("odds")).agg(F.count(F.lit(1)).alias("n")).collect()
    model.calibrate([(r["seed"], r["odds"], r["n"]) for r in bins])
    return odds.where(F.col("odds") >= model.threshold).select("record_id").distinct()


def question_languages(questions: DataFrame, languages: LanguageModel) -> DataFrame:
    """task_id, langs (the languages of its questions), one row for each task."""
    shared = questions.sparkSession.sparkContext.broadcast(languages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = shared.value.scores(pdf["question"].tolist())
            best = [LANGUAGES[i] for i in np.argmax(scores, axis=1)]
            yield pd.DataFrame({"task_id": pdf["task_id"], "lang": best})

    return questions.mapInPandas(run, "task_id string, lang string").groupBy("task_id").agg(F.array_distinct(F.collect_list("lang")).alias("langs"))


def ends_inside(answer: str, question: str) -> bool:
    """Whether the last words of an answer are words of the question in a row."""
    plain = lambda t: " ".join(_WORDS.findall(_QUOTE_MARK.sub("", _NOTHING.sub(" ", t)).casefold()))
    tail = plain(answer[-60:]).split(" ", 1)[-1][-24:]
    return tail in plain(question)


def copied_share(answer: str, question: str) -> tuple[float, float]:
    """(share of the answer's words that are the question's, the other way round).

    Words count as often as they occur, quote and comment marks do not.
    """
    plain = lambda t: Counter(w.casefold() for w in _WORDS.findall(_QUOTE_MARK.sub("", _NOTHING.sub(" ", t))))
    a, q = plain(answer), plain(question)
    common = sum((a & q).values())
    return common / max(1, sum(a.values())), common / max(1, sum(q.values()))


def copies(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """record_id of answers that only hold text of a question of their task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for text, cut, question in zip(pdf["text"], pdf["cut"], pdf["question"]):
                mine, theirs = copied_share(text, question)
                keep.append(mine >= COPY_SHARE and theirs >= COPY_OF_QUESTION and not (cut and not ends_inside(text, question)))
            yield pdf.loc[np.array(keep, dtype=bool), ["record_id"]]

    return candidates.join(questions, "task_id").select("record_id", "text", "cut", "question").mapInPandas(run, "record_id long").distinct()


def defects(records: DataFrame, questions: DataFrame, ends: EndModel, languages: LanguageModel, stage=lambda df, label: df) -> DataFrame:
    """record_id, defect of each defective answer.

    ``questions`` has task_id and question; nulls in either are left out.
    """
    asked = questions.where(F.col("task_id").isNotNull() & F.col("question").isNotNull()).select("task_id", "question").distinct()
    rows = stage(slim(records, ends, languages), "answers")
    copied = copies(rows.where(F.col("text").isNotNull()).select("record_id", "task_id", "text", F.coalesce(F.col("defect") == "truncated", F.lit(False)).alias("cut")), asked).withColumn("copied", F.lit(True))
    refused = refusals(rows, asked).withColumn("refused", F.lit(True))
    langs = question_languages(asked, languages)
    index = F.create_map(*[x for i, language in enumerate(LANGUAGES) for x in (F.lit(language), F.lit(i))])

    def differs(scores: str) -> F.Column:
        best = F.array_max(scores)
        own = F.array_max(F.transform("langs_", lambda l: F.element_at(F.col(scores), index[l] + 1)))
        return F.col(scores).isNotNull() & (best - own >= MARGIN)

    joined = (
        rows.drop("text", "seed").join(langs, "task_id", "left").join(copied, "record_id", "left").join(refused, "record_id", "left")
        .withColumn("langs_", F.coalesce("langs", F.array(F.lit("en"))))
    )
    defect = (
        F.when(F.col("refused"), "refusal").when(F.col("copied"), "copied")
        .when(F.col("defect").isin("empty", "language"), F.col("defect"))
        .when(F.col("defect") == "truncated", "truncated")
        .when(differs("prose") | differs("comments"), "language")
    )
    return joined.select("record_id", defect.alias("defect")).where(F.col("defect").isNotNull())
