import json

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sparloom.functions import arrays, jsonx, text



def check(spark, function, cases, schema="c0 string"):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, " + schema)
    got = [r["x"] for r in df.select("i", function(F.col("c0")).alias("x")).orderBy("i").collect()]
    assert got == [e for _, e in cases]


def test_text(spark):
    check(spark, text.normalize_prompt, [("a b​c﻿\td\n", "a bc\td\n"), (None, None), ("", ""), ("ß🙂　x", "ß🙂 x")])
    check(spark, text.normalize_difficulty, [(" Very-Hard ", "VERY_HARD"), ("mediumhard", "MEDIUM_HARD"), ("easy", "EASY"), (None, None), ("odd one", "ODD_ONE")])
    check(spark, text.safe_name, [("a b/c", "a_b_c"), ("///", "task"), (None, "task"), ("__x.-", "x.-"), ("é", "task")])
    check(spark, text.first_fence, [("x ```py\na\n``` ```\nlonger one\n```", "a"), ("[PYTHON]b[/PYTHON]", "b"), ("c", "c"), (None, None)])
    check(spark, text.longest_fence, [
        ("```\nvery long other\n``` ```python\nab\n```\n```py\ncd\n```", "ab"), ("```js\na\n```\n```c\nabc\n```", "abc"), ("```python\nopen", "open"), ("<python>x</python>", "x"), (None, None)])
    check(spark, text.unwrap_fence, [("```json\n{}\n```", "{}"), ("x ```json\n{}\n```", "x ```json\n{}\n```"), ("```\na\n```\n```\nb\n```", "```\na\n```\n```\nb\n```")])
    check(spark, text.after_reasoning, [("<think>a</think> b", "b"), ("<think>a", ""), ("  c\n", "c"), (None, None)])
    check(spark, text.escape_repaired, [('{"a": "\\d"}', '{"a": "\\\\d"}'), ('"\\n"', '"\\n"')])
    check(spark, text.generic_instruction, [("Fix this issue.", True), ("clarify", True), ("Replace x with y", False)])
    check(spark, text.collapse, [("  A \n b ", "a b")])


def test_json(spark):
    whole = json.dumps({k: [] for k in jsonx.CONTRACT_KEYS})
    check(spark, jsonx.is_object, [("{}", True), ("[1]", False), ('{"a": 1} x', False), ('{"a":1}\n{"b":2}', False), (None, False), ("{'a': 1}", False), ("", False)])
    check(spark, jsonx.has_exact_keys, [(whole, True), (json.dumps({"interface": 1}), False), ("x", False), (None, False)])
    check(spark, jsonx.missing_keys, [(json.dumps({"interface": 1, "z": 2}), ["invariants", "postconditions", "preconditions"]), ("x", None)])
    check(spark, jsonx.extra_keys, [(json.dumps({"interface": 1, "z": 2}), ["z"])])
    check(spark, lambda c: jsonx.canonical_contract(c).isNotNull(), [(whole, True), (json.dumps({"contract": json.loads(whole)}), True), ("{}", False), (None, False)])
    check(spark, jsonx.parse_jsonish_udf, [('{"b": 1, "a": 2}', '{"a":2,"b":1}'), ("{'a': (1, 2)}", '{"a":[1,2]}'), ("plain", '"plain"'), ("  ", None), (None, None)])
    chatter = "Here:\n```json\n" + whole + "\n``` done"
    check(spark, lambda c: jsonx.find_contract_udf(c).isNotNull(), [(chatter, True), ("<think>{}</think>" + whole, True), ("{ x " + whole, True), ("{}", False), (None, False)])
    check(spark, jsonx.complete_object_udf, [('x {"a": "}"} y', '{"a": "}"}'), ("{ {", None)])
    check(spark, jsonx.normalize_json_blanks_udf, [('{"a ":  1}', '{"a ":  1}')])


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=8), st.text(alphabet="ab{}\"\\ "))
def test_scanner_finds_objects(value, noise):
    body = json.dumps({"k": value})
    assert jsonx.scan_object(body + noise) == body
    assert jsonx.literal(body) == {"k": value}


def test_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 4, 5]), ([], [1]), ([1, None], [1, None])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(arrays.common_prefix(F.col("a"), F.col("b"))).collect()] == [2, 0, 2]
    assert [r[0] for r in df.select(arrays.mask_prefix(F.col("b"), F.lit(2))).collect()][0] == [-100, -100, 4, 5]
    assert [r[0] for r in df.select(arrays.pad(F.col("a"), F.lit(4), 0)).collect()][0] == [1, 2, 3, 0]
    n = spark.createDataFrame([(0,), (1,), (2,), (10,), (25,), (35,)], "n long")
    assert [r[0] for r in n.select(arrays.validation_count(F.col("n"), 0.1)).collect()] == [0, 0, 1, 1, 2, 4]
    assert [r[0] for r in spark.createDataFrame([(list(range(1, 11)),), (list(range(1, 22)),)], "v array<int>").select(arrays.index_p95(F.col("v"))).collect()] == [9, 19]


def test_nested(spark):
    df = spark.createDataFrame([([[1, 2]], ["a", "b"], {"1": "x", "k": "y"}), (None, None, None)], "n array<array<int>>, s array<string>, m map<string,string>")
    row = df.select(
        arrays.unwrap_ids(F.col("n")), arrays.replace_at(F.col("s"), F.lit(1), F.lit("z")), arrays.append_or_replace(F.col("s"), F.lit(2), F.lit("z")), arrays.integer_keys(F.col("m"))
    ).collect()
    assert tuple(row[0]) == ([1, 2], ["a", "z"], ["a", "b", "z"], {1: "x"})
    assert row[1][0] is None and row[1][1] is None
    whole = {"interface": {}, "preconditions": [], "postconditions": [], "invariants": []}
    check(spark, jsonx.contract_fault, [(None, "missing"), ("{", "invalid_json"), ("{}", "missing_keys"), (json.dumps(whole | {"x": 1}), "extra_keys"), (json.dumps(whole | {"interface": []}), "wrong_types"), (json.dumps(whole), None)])
