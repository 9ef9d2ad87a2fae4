import json
import random

import pytest

from sparloom.llm import langid, pairs, truncation as T

EN = ["We keep the boxes sorted by weight and scan them once.", "Ties are broken by the smaller index.", "First we read the values, then the sum is updated for each of them.", "The edge case with no rows returns zero."]
DE = ["Wir sortieren die Kisten nach Gewicht und gehen sie einmal durch.", "Zuerst lesen wir die Werte ein, danach wird die Summe angepasst.", "Gibt es gar keine Zeilen, ist das Ergebnis null."]
FR = ["Nous trions les caisses selon leur poids puis nous les parcourons une fois.", "Quand il n'y a pas de lignes, le résultat est zéro."]
ES = ["Ordenamos las cajas por su peso y las recorremos una vez.", "Cuando no hay filas, el resultado es cero."]
QUESTION = "There is a tree of n boxes rooted in Hallow. Nobody may take boxes with weight above 12. Find the largest sum of weights that Tom can reach. Print one integer."
CODE = "def find_boxes(rows):\n    total = 0\n    for row in rows:\n        if row % 3 == 1:\n            total += row\n    return total\n\nimport sys\ndata = sys.stdin.read().split()\nprint(find_boxes([int(t) for t in data]))"


def answers(n=400):
    rng = random.Random(1)
    out = []
    for i in range(n):
        body = CODE.replace("find_boxes", f"{rng.choice(['scan', 'weigh', 'fold'])}_{rng.choice(['pegs', 'jars', 'kilns'])}").replace("total", rng.choice(["acc", "goal", "span"]))
        fenced = f"```python\n{body}\n```"
        out.append(rng.choice([fenced, body, " ".join(rng.sample(EN, 2)) + "\n\n" + fenced, fenced + "\n\n" + " ".join(rng.sample(EN, 2)), "<think>" + EN[0] + "</think>\n" + fenced]))
    return out


@pytest.fixture(scope="module")
def ends():
    return T.fit(answers())


@pytest.fixture(scope="module")
def languages():
    return langid.LanguageModel.fit({"en": EN * 3 + [QUESTION], "de": DE * 3, "fr": FR * 3, "es": ES * 3})


def test_held_out_cuts(ends):
    rng = random.Random(9)
    whole = answers(600)[400:]
    assert sum(T.is_cut(t, ends) for t in whole) <= 4
    cut = [t[:rng.randrange(len(t) // 4, len(t) - 4)] for t in whole]
    assert sum(T.is_cut(t, ends) for t in cut) >= 0.93 * len(cut)


def test_cut_cases(ends):
    contract = json.dumps({"interface": {}, "postconditions": [{"id": "Q1", "expression": "x[0] > 1"}]})
    for text in ["", "   \n", "​", "```python\n```", contract, "```json\n" + contract + "\n```", "{'a': [1]}", '{"a": 1,}', contract + "\n\n" + EN[0], "int f() {\n  return 1;\n}"]:
        assert not T.is_cut(text, ends), text
    for text in [contract[:-1], contract[:-12], "```json\n" + contract, "<think>We try", "We keep the b�", "x…", "```python\nx = 1\n```\n\n```py", CODE[:-5], CODE[:60]]:
        assert T.is_cut(text, ends), text


def test_rates_and_empty_table(spark, stage):
    rows = [(i, "m" if i % 2 else None, t) for i, t in enumerate(answers(60))] + [(100, "m", None), (101, "m", " "), (102, "m", CODE[:-8]), (102, "m", CODE[:-8])]
    df = spark.createDataFrame(rows, "record_id long, model string, raw_response string")
    scored = T.scored_tables({"a": df, "b": df.limit(0)}, stage)
    assert scored.where("key_ = 102 and cut_").count() == 2 and scored.where("key_ in (100, 101)").count() == 0
    assert {r["model"] for r in T.rates(scored).collect()} == {"m", None}


def test_language_model(languages):
    scores = languages.scores(["Wir lesen die Werte ein", "Quand il n'y a pas de lignes", "We read the values", "", "ab", "Cuando no hay filas"])
    assert [langid.LANGUAGES[r.argmax()] for r in scores[[0, 1, 2, 5]]] == ["de", "fr", "en", "es"]
    assert not scores[3].any() and not scores[4].any()
    many = languages.scores(["We read the values"] * 20 + ["ab"] + DE)
    assert abs(many[0] - scores[2]).max() < 1e-3 and many[-1].argmax() == 1


def test_defects(spark, stage, ends, languages):
    fence = f"```python\n{CODE}\n```"
    cases = [
        ("q", fence, CODE, None), ("q", None, CODE, None), ("q", fence + "\n\n" + EN[0], CODE, None), ("q", "I cannot promise the fastest version, but it is complete.\n\n" + fence, CODE, None),
        ("q", None, None, "empty"), ("q", "​", " ", "empty"), ("q", "```python\n```", "", "empty"), ("q", "<think>\n</think>", None, "empty"),
        ("q", "", CODE, None), ("q", "Sadly I won't write code for this one.", "", "refusal"), ("q", None, "# I must decline to answer.\n# Ask a tutor.", "refusal"),
        ("q", "def f(x):\n    raise NotImplementedError('I am unable to help.')", None, "refusal"), ("q", "```python\ndef f(x):\n    # I can't do this\n    pass\n```", None, "refusal"),
        ("q", QUESTION, "", "copied"), ("q", "```python\n# " + QUESTION.replace(". ", ".\n# ") + "\n```", None, "copied"), ("q", QUESTION.upper(), None, "copied"), ("q", "> " + QUESTION + "\n\n" + fence, CODE, None),
        ("q", fence[:-40], CODE[:-36], "truncated"), ("q", CODE[:-5], None, "truncated"), ("q", EN[0] + " First we re", CODE, "truncated"),
        ("q", DE[0] + " " + DE[1] + "\n\n" + fence, CODE, "language"), ("q", "```python\n# " + FR[0] + "\n# " + FR[1] + "\n" + CODE + "\n```", None, "language"), ("q", " ".join(ES), "", "language"),
        ("q", "```\n#include <vector>\nint f(int x) {\n    return x;\n}\n```", None, "language"), ("g", DE[0] + " " + DE[1] + "\n\n" + fence, CODE, None), ("g", EN[0] + " " + EN[2] + "\n\n" + fence, CODE, "language"),
        ("none", fence, CODE, None), (None, fence, CODE, None), ("null", fence, CODE, None),
    ]
    rows = [(i, t, r, c, "x") for i, (t, r, c, _) in enumerate(cases)] + [(100, "q", None, None, "x"), (100, "q", None, None, "x")]
    records = spark.createDataFrame(rows, "record_id long, task_id string, raw_response string, code string, defect string")
    questions = spark.createDataFrame([("q", QUESTION), ("q", QUESTION), ("g", " ".join(DE)), ("null", None), (None, "x")], "task_id string, question string")
    got = [tuple(r) for r in pairs.defects(records.drop("defect"), questions, ends, languages, stage).collect()]
    assert got.count((100, "empty")) == 2
    found = dict(got)
    assert {i: found.get(i) for i in range(len(cases))} == {i: d for i, (*_, d) in enumerate(cases)}
    assert pairs.defects(records.limit(0), questions.limit(0), ends, languages, stage).count() == 0


def test_long_statement_that_stops():
    from sparloom.llm.truncation import unfinished_code

    table = "T = {\n" + "".join(f"    'k{i}': {i},\n" for i in range(20))
    tries = "import os\n\ndef f():\n    try:\n" + "".join(f"        g({i})\n" for i in range(20)).rstrip("\n")
    for code in (table, table + "    'k2", tries, "x = 1\n" + table.replace("T", "x"), "s = \"\"\"\n" + "line\n" * 30):
        assert unfinished_code(code) is True
    for code in ("int main() {\n" + "  f();\n" * 20, "x = 1\ny = = 2\n" + "z = 1\n" * 20, "a = [1;\n" + "2;\n" * 20):
        assert unfinished_code(code) is None
    assert unfinished_code(table + "}\n") is False
