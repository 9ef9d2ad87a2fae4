import json
import tomllib

from hypothesis import given, settings, strategies as st

from sparloom.llm import syntax as S

SCHEMA = "file_id long, file_path string, code string, run_id string, valid_ string"


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, p, c, "r", "x") for i, (p, c, _) in enumerate(rows)], SCHEMA)
    return {r["key_"]: r["valid_"] for r in S.check_files(df, "file_id", "file_path", "code", "run_id", **more).collect()}


def test_languages(spark):
    rows = [
        ("a.py", "x = 1\r\n", True), ("a.PY", "print 'x'", False), ("a.pyw", "", True), ("a.py3", "﻿x = 1", True), ("a.py", "def f():\n", False),
        ("a.py", "f'{x[\"a\"]}'", True), ("a.py", "match x:\n  case 1: pass\n", True), ("a.py", "<<<<<<< a\nx\n=======\ny\n>>>>>>> b\n", False), ("a.py", "x = '\0'", False),
        ("a.json", "{}", True), ("a.json", "", False), ("a.json", "NaN", False), ("a.json", '{"a": 1, "a": 2}', True), ("a.json", "{'a': 1}", False), ("a.json", "[1,]", False), ("a.JSON", '"' + "9" * 5000 + '"', True), ("a.json", "9" * 5000, True),
        ("a.jsonl", '{}\n\n[1]\r\n', True), ("a.jsonl", "", True), ("a.jsonl", "{}\n{", False), ("a.jsonl", '{"a":\n1}', False),
        ("a.toml", "", True), ("a.toml", 'a = "x"\n[b]\nc = 1979-05-27', True), ("a.toml", "a = 1\na = 2", False), ("a.toml", "a = '''x", False), ("a.toml", "a = 'C:\\x'", True),
    ]
    assert found(spark, rows) == {i: ok for i, (_, _, ok) in enumerate(rows)}
    assert found(spark, [("a.md", "(", None), (None, "(", None), ("a.py", None, None)]) == {}
    assert found(spark, []) == {}


def test_long_files_are_reduced_over_chunks(spark):
    body = "def f(x):\n    '''doc ( ['''\n    return [x, (1, 2)]  # )\n\n"
    rows = [
        ("a.py", body * 300, True), ("a.py", body * 300 + "x = (", False), ("a.py", body * 150 + "'''" + body * 150, False), ("a.py", "x = [\n" + "1,\n" * 9000 + "]\n", True),
        ("a.json", json.dumps([["a\\\"[" * 50] * 40] * 3), True), ("a.json", json.dumps([["a"] * 9000])[:-1], False), ("a.toml", 'a = """' + "x]\n" * 9000 + '"""\n', True),
    ]
    assert found(spark, rows, chunk_chars=64) == {i: ok for i, (_, _, ok) in enumerate(rows)}


def test_rates(spark):
    df = spark.createDataFrame([(0, "a.py", "x", "r", ""), (1, "b.py", "(", "r", ""), (2, "c.json", "{}", None, "")], SCHEMA)
    rows = {(r["run_id"], r["language"]): (r["n_files"], r["n_invalid"], r["rate"]) for r in S.rates(S.check_files(df, "file_id", "file_path", "code", "run_id")).collect()}
    assert rows == {("r", "python"): (2, 1, 0.5), (None, "json"): (1, 0, 0.0)}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab()[]{}'\"#\\\n", max_size=60), st.integers(1, 7))
def test_summaries_combine_as_the_whole(text, size):
    for language in ("python", "json", "toml"):
        parts = [text[i:i + size] for i in range(0, len(text), size)] or [""]
        total = None
        for part in parts:
            one = {s: S.scan(language, part, s) for s in S.STATES[language]}
            total = one if total is None else S.combine_maps(total, one)
        if "\\" not in text and "'''" not in text and '"""' not in text:  # tokens of several signs may lie across a cut
            assert total["N"] == S.scan(language, text, "N")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="a=1\n[]\"'#.", max_size=30))
def test_toml_agrees(text):
    try:
        tomllib.loads(text)
        ok = True
    except ValueError:
        ok = False
    assert S.valid("toml", text, S.scan("toml", text, "N")) == ok


PY_PARTS = [
    "x = 1\n", "def f(a):\n    return a\n", "@dec(\n  1)\n", "@dec\n", "# note (\n", "\n", "if x:\n    pass\n", "else:\n    pass\n", "s = '''a\nb ( '''\n", 's = f"""{x:{y}} {{ {d[\'k\']} \n{(1,\n2)}"""\n',
    "f'{x!r:>{w}} \\N{BULLET} {\"q\" if a else {1: 2}[1]}'\n", "rf'\\{x}'\n", "y = 1 + \\\n", "2\n", "z = [\n1,\n", "]\n", "'abc\\\ndef'\n", "f'{a\n}'\n", "print 'x'\n", "  indented\n", "try:\n    x\nexcept E:\n    pass\n", "class A:\n    '''doc'''\n",
    "match x:\n    case 1:\n        pass\n", "b'(' rb\"[\"\n", "é = 'ü'\n", "x = '\n", "lambda: (yield)\n", "f'{x:%H:%M}'\n", "f'{lambda x: 1}'\n", "async def g():\n    await h()\n", "<<<<<<< a\n", "\t\tx\n", "f'{{}}' '}'\n", "f'}'\n",
]
JSON_PARTS = ['{', '}', '[', ']', ',', ':', '"a"', '"b\\",["', "1", "null", " ", "\n", '"k": [1, 2]', '{"x": {"y": "],"}}', "tru", '[1, [2, 3], {}]', '"a":', ", "]
TOML_PARTS = ["a = 1\n", "b = 'x'\n", "[t]\n", "[t.u]\n", "[[v]]\n", "c = [\n1,\n2]\n", 'd = """x\n[y]\n"""""\n', "e = {f = 1}\n", "a.g = 2\n", "[e]\n", "# c [\n", "h = 1979-05-27\n", "i = '''a'b''''\n", "j = \n", "k = \"\\u00e9\"\n", "[v]\n", '"q r" = 1\n', "[[t]]\n", "c.x = 1\n"]


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(["python", "json", "jsonl", "toml"]), st.data(), st.integers(1, 40))
def test_statement_groups_agree_with_the_whole(language, data, size):
    parts = {"python": PY_PARTS, "toml": TOML_PARTS}.get(language, JSON_PARTS)
    text = "".join(data.draw(st.lists(st.sampled_from(parts), max_size=9)))
    if language == "json":
        text = data.draw(st.sampled_from(["[{}]", "{{{}}}", "{}"])).format(text)
    assert S.valid(language, text, None, size) == S.parses(language, text), text


def test_the_reduction_decides(monkeypatch):
    files = ["x = '''\n" + "y = 1\n" * 80, "z = [\n" + "1,\n" * 200, "def f():\n    return 1\n\n" * 40 + "w = )\n"]
    asked = []
    monkeypatch.setitem(S.GRAMMARS, "python", asked.append)
    assert [S.valid("python", f) for f in files] == [False] * 3 and asked == []
    text = "def f():\n    return '''\nx = 1\n'''\n\n" * 60
    assert S.valid("python", text) and len(asked) > 3 and "".join(asked) == text and max(map(len, asked)) < 600
