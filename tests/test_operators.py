import pytest
from pyspark.sql import functions as F

from sparloom.operators import backend, contracts, evaluation, execution, runs, selection
from sparloom.sources import files, sinks

CONTRACT = (
    "struct<interface:struct<mode:string,class_name:string,function_name:string,signature:string,input_channel:string,output_channel:string>,"
    "preconditions:array<struct<id:string,expression:string,description:string>>,postconditions:array<struct<id:string,expression:string,description:string>>,"
    "invariants:array<struct<id:string,expression:string,description:string>>>"
)


def test_task_results(spark):
    tests = spark.createDataFrame(
        [("a", 0, "passed"), ("a", 1, "passed"), ("b", 0, "passed"), ("b", 1, "timeout"), ("b", 2, "passed"), ("c", 0, "runtime_error")], "task string, i int, outcome string"
    )
    tasks = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "task string")
    results = evaluation.task_results(tests, tasks, "task", ["i"])
    rows = {r["task"]: (r["tests_total"], r["tests_run"], r["tests_passed"], r["passed"], r["failure_type"], r["pass_percentage"]) for r in results.collect()}
    assert rows == {"a": (2, 2, 2, True, None, 100.0), "b": (3, 2, 1, False, "timeout", 33.3333), "c": (1, 1, 0, False, "runtime_error", 0.0), "d": (0, 0, 0, False, "no_tests", 0.0)}
    assert evaluation.run_summary(results).first()["pass_at_1"] == 0.25
    assert evaluation.run_summary(results.limit(0)).first()["selected"] == 0


def test_split_sizes_and_order(spark):
    rows = [(i, "a" if i < 25 else "b" if i < 27 else "c") for i in range(28)]
    df = spark.createDataFrame(rows, "id long, s string")
    split = selection.stratified_split(df, "s", "id")
    sizes = {(r["s"], r["assigned"]): r["count"] for r in split.groupBy("s", "assigned").count().collect()}
    assert sizes == {("a", "val"): 2, ("a", "train"): 23, ("b", "val"): 1, ("b", "train"): 1, ("c", "train"): 1}
    again = selection.stratified_split(df.repartition(7), "s", "id")
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, again.collect()))


def test_reasons_and_leakage(spark):
    rows = [(None, "easy", 100, 100), ("t", "odd", 1, 1), ("t", "Easy", None, 1), ("t", "hard", 60, 10), ("t", "HARD", 60, 60)]
    df = spark.createDataFrame(rows, "task_id string, difficulty string, number_of_test_cases int, test_cases_passed int")
    assert [r[0] for r in df.select(selection.rejection()).collect()] == ["missing_task_id", "invalid_difficulty", "insufficient_tests", "low_pass_ratio", None]
    assert [r[0] for r in df.select(selection.rejection(all_cleaned=True)).collect()] == ["missing_task_id", "invalid_difficulty", None, None, None]
    with pytest.raises(ValueError, match="leak: t"):
        selection.require_none(selection.shared_keys(df, df, "task_id"), "leak", "task_id")
    selection.require_none(df.limit(0), "leak", "task_id")


def test_structure_and_expressions(spark):
    face = ("functional", None, "f", "f(x)", None, None)
    rows = [
        (1, (face, [("P1", "x > 0", "d")], [("Q1", "x", "d")], [])),
        (2, (("other", None, None, None, None, None), [("X1", "stdout == 1", " ")], [], None)),
        (3, None),
        (4, (("stdin_stdout", None, None, "stdin -> stdout", "stdin", "stdout"), [], [("Q2", "all(1 for y in x)", "d")], [])),
    ]
    df = spark.createDataFrame(rows, f"id int, contract {CONTRACT}")
    got = {r["id"]: [i["type"] for i in r["i"]] for r in df.select("id", contracts.structure_issues(F.col("contract")).alias("i")).collect()}
    assert got == {1: [], 2: ["invalid_mode", "missing_clause", "wrong_id_letter", "missing_description", "output_in_precondition"], 3: ["missing_contract"], 4: ["id_out_of_sequence"]}
    faults = sorted(tuple(r) for r in contracts.expression_issues(df, "contract", "id").collect())
    assert [f[:3] for f in faults] == [(4, "postconditions[0].expression", "unused_quantified_variable_hint")]


def test_runs(spark, tmp_path):
    jobs = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "c")], "run_id string, task_id string")
    records = spark.createDataFrame([("r", "a", "x", None), ("r", "b", " ", None), ("r", "c", "y", "failed")], "run_id string, task_id string, raw_response string, generation_issue string")
    assert sorted(r["task_id"] for r in runs.remaining(jobs, records, ["run_id", "task_id"], runs.finished_response()).collect()) == ["b", "c"]
    joined = runs.with_results(jobs, records.where("task_id = 'a'").select("task_id", "raw_response"), "task_id", F.lit("missing"))
    assert sorted((r["task_id"], r["status"]) for r in joined.collect()) == [("a", "ok"), ("b", "missing"), ("c", "missing")]
    with pytest.raises(ValueError, match="b, c"):
        runs.with_results(jobs, records.where("task_id = 'a'").select("task_id"), "task_id", F.lit("missing"), policy="raise")
    lengths = spark.createDataFrame([("m", n) for n in [5, 1, 9, 9, 3, 7, 2, 2, 8, 10]] + [("k", 4), ("k", None)], "g string, n long")
    a = sorted(tuple(r) for r in runs.length_summary(lengths, "g", "n").collect())
    b = sorted(tuple(r) for r in runs.length_summary_exact(lengths, "g", "n").collect())
    assert a == b == [("k", 1, 4, 4, 4, 4), ("m", 10, 1, 6, 9, 10)]
    numbered = runs.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")).repartition(5), ["v"])
    assert [r["task_index"] for r in numbered.orderBy("v").collect()] == list(range(1000))
    assert runs.shard(numbered, 990, None).count() == 10 and runs.shard(numbered, 10, 5).count() == 5
    paths = spark.createDataFrame([("r", "x/checkpoint-9"), ("r", "x/checkpoint-10"), ("r", "x/none")], "r string, p string")
    assert runs.latest_by_suffix(paths, "r", "p").first()["latest"] == "x/checkpoint-10"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('﻿{"id": 1}\n\n{"id": 2}\n')
    assert files.read_jsonl(spark, str(tmp_path / "in")).count() == 2
    (tmp_path / "in" / "b.jsonl").write_text("[1]\n")
    with pytest.raises(Exception, match="not a JSON object"):
        files.read_jsonl(spark, str(tmp_path / "in")).collect()
    assert files.read_jsonl(spark, str(tmp_path / "in"), strict=False).count() == 2
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "tasks.json").write_text('{"data": [{"task_id": "x"}, 3]}')
    (tmp_path / "t" / "_skip.json").write_text('{"task_id": "s"}')
    (tmp_path / "t" / "one.json").write_text('{"task_id": "tasks", "question": "q"}')
    assert files.load_tasks(spark, str(tmp_path / "t")).count() == 2
    with pytest.raises(Exception, match="no object"):
        files.load_tasks(spark, str(tmp_path / "t"), strict=True).collect()
    index = files.index_records(files.read_bodies(spark, str(tmp_path / "t")))
    assert [r["key"] for r in files.ambiguous(index).collect()] == ["tasks"]
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    sinks.write_jsonl(df, str(tmp_path / "o"))
    assert '"b":null' in "".join(p.read_text() for p in (tmp_path / "o").glob("*.json"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_jsonl(df, str(tmp_path / "o"))
    sinks.write_kept_and_removed(df, F.when(F.col("b").isNull(), "no_b"), str(tmp_path / "k"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "k")).count() == 1 and spark.read.parquet(str(tmp_path / "r")).first()["reason"] == "no_b"
    jobs = spark.createDataFrame([("a b",), ("a/b",), ("c",)], "t string")
    assert sinks.clashing_outputs(jobs, "t").first()["output_name"] == "a_b.json"
    assert sinks.summary_name(0, None) == "_summary_0_all.json"


def test_backend_and_repair(spark):
    df = spark.createDataFrame([(1, "p"), (2, None), (3, "q")], "i int, prompt string")
    rows = backend.generate(df, "prompt", lambda: backend.TemplateBackend("<{prompt}>")).orderBy("i").collect()
    assert [r["response"] for r in rows] == ["<p>", None, "<q>"]

    class Broken:
        def generate(self, prompts):
            raise backend.FatalError("down")

    assert [r["error"] for r in backend.generate(df, "prompt", Broken).orderBy("i").collect()] == ["FatalError: down", None, "FatalError: down"]
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return ["ok"]

    assert backend.with_retries(flaky, 5, waits.append) == ["ok"] and waits == [1.0, 2.0]
    loop = backend.repair_loop(
        spark.createDataFrame([(1, "xxx"), (2, "y"), (3, None), (4, "xxxxxxx")], "i int, v string"), "i", "v",
        lambda t: ["x"] * t.count("x"), lambda t, fault, n: t.replace("x", "", 1), most=5,
    )
    assert sorted((r["key"], r["resolved"], r["attempts"]) for r in loop.collect()) == [("1", True, 3), ("2", True, 0), ("3", False, 0), ("4", False, 5)]


def test_execution(spark):
    assert execution.same_output(" 1\n2 \n", "1\n2") and execution.same_output("0.50", "0.5") and execution.same_output("b\na", "a\nb")
    assert not execution.same_output("1", "2")
    df = spark.createDataFrame(
        [("ok", "print(int(input()) * 2)", '{"inputs": ["2", "3"], "outputs": ["4", "6"]}'), ("bad", "print(1", '{"inputs": ["2"], "outputs": ["4"]}'), ("none", None, "{}"), ("wrong", "print(5)", '{"inputs": ["2", "1"], "outputs": ["4", "5"]}'), ("data", "x", "[")],
        "task_id string, code string, tests string",
    )
    with pytest.raises(PermissionError):
        execution.run_tests(df)
    got = sorted(tuple(r) for r in execution.run_tests(df, allow_untrusted=True).collect())
    assert got == [("bad", 0, "syntax_error"), ("data", 0, "invalid_test_data"), ("none", 0, "missing_code"), ("ok", 0, "passed"), ("ok", 1, "passed"), ("wrong", 0, "logical_error")]
    assert execution.run_one("while True: pass", "", "", seconds=1.0) in ("timeout", "runtime_error")


def test_execution_by_calls_and_files(spark):
    double = "def double(n):\n    print('noise', end='')\n    return n * 2"
    both = '{"inputs": ["2", [3]], "outputs": ["4", [6]]%s}'
    df = spark.createDataFrame(
        [
            ("column", double, both % "", "double"), ("inside", double, both % ', "fn_name": "double"', None),
            ("method", "class Solution:\n    def add(self, a: List[int], b):\n        return tuple(a) + (b,)", '{"inputs": ["[1, 2]\\n3", [[1], 2.5]], "outputs": [[1, 2, 3], "[1, 2.5000000001]"]}', "add"),
            ("words", "def add(a, b, c): return a + b + c", '{"inputs": ["328 359 77"], "outputs": ["764"]}', "add"),
            ("keys", "def at(d, s): return [d[1], s]", '{"inputs": [[{"1": true}, "x y"]], "outputs": [[true, "x y"]]}', "at"),
            ("wrong", "def double(n): return n", both % "", "double"), ("absent", "x = 1", both % "", "double"),
            ("surplus", "print(input())", '{"inputs": ["1", "2"], "outputs": ["1"]}', None),
        ],
        "task_id string, code string, tests string, fn_name string",
    )
    got = sorted(tuple(r) for r in execution.run_tests(df, allow_untrusted=True).collect())
    assert got == [
        ("absent", 0, "runtime_error"), ("column", 0, "passed"), ("column", 1, "passed"), ("inside", 0, "passed"), ("inside", 1, "passed"), ("keys", 0, "passed"),
        ("method", 0, "passed"), ("method", 1, "passed"), ("surplus", 0, "invalid_test_data"), ("words", 0, "passed"), ("wrong", 0, "logical_error"),
    ]
    files = "n = int(open('input.txt').read())\nopen('output.txt', 'w').write(str(n + 1))"
    assert execution.run_one(files, "4", "5") == "passed" and execution.run_one(files, "4", "6") == "logical_error"
    assert execution.run_one("import os\nos.lseek(0, 0, 0)\nprint(input())", "7", "7") == "passed"
    assert execution.run_one("raise ValueError", "4", "5") == "runtime_error"
