import json

import os

import pytest
from pyspark.sql import functions as F

from sparloom import storage
from sparloom.functions import jsonx
from sparloom.operators import backend, evaluation, runs, selection, verifier as V
from sparloom.sources import sinks

CLAUSE = {"id": "Q1", "expression": "x > 0", "description": "d"}


def test_analysis_never_raises():
    for contract in (None, [], {}, {"interface": None}, {"postconditions": [None, 1, {}, {"id": None, "expression": 3, "description": []}], "preconditions": {}, "invariants": "x"}):
        meaning, form = V.analyse(None, contract)
        assert form and all(set(i) == {"code", "location", "detail"} for i in form)
    assert V.expression_issues("(" * 5000, "at")[0]["code"] == "invalid_expression_syntax"


def test_blocking_and_distinct():
    form = [V.found("missing_top_level_keys", "contract", ["invariants"]), V.found("missing_top_level_keys", "contract", ["interface"]), V.found("invalid_description", "x"), V.found("non_boolean_result", "y")]
    assert [i["location"] for i in V.blocking(form)] == ["contract", "y"]
    a = V.semantic("t", "l", "a", "i")
    assert V.distinct([a, dict(a), V.semantic("t", "l", "a", "j")]) == [a, V.semantic("t", "l", "a", "j")]


def test_repair_targets():
    issue, hint = V.semantic("vague_clause", "invariants[0]", "clarify", "x"), V.semantic("missing_clause", "postconditions", "add", "y")
    form = [V.found("clause_not_object", "postconditions[0]"), V.found("invalid_description", "preconditions[0]")]
    assert V.repair_target("DEFECTIVE", issue, None, form) is issue and V.repair_target("UNCERTAIN", None, hint, form) is hint
    assert V.repair_target("UNCERTAIN", None, None, form)["location"] == "postconditions[0]" and V.repair_target("CORRECT", None, None, form[1:]) is None
    assert V.widened(issue, 2) is issue and V.widened(issue, 3)["location"] == "invariants" and V.widened(issue, 2, early=True)["location"] == "invariants"
    assert V.widened(issue | {"action": "remove"}, 5)["location"] == "invariants[0]" and V.widened(hint | {"location": "interface"}, 5)["location"] == "interface"
    assert V.target_key(issue | {"location": "invariants[0].expression"}) == V.target_key(issue)


def test_patches():
    held = {"interface": {}, "preconditions": [], "postconditions": [CLAUSE, "broken"], "invariants": []}
    assert V.patched(held, "postconditions[1]", "replace", CLAUSE | {"id": "Q7"})["postconditions"][1]["id"] == "Q7"
    assert V.patched(held, "invariants", "add", CLAUSE)["invariants"][0]["id"] == "I1" and held["invariants"] == []
    for at, action, value in [("postconditions", "clarify", CLAUSE), ("postconditions[5]", "remove", None), ("postconditions[0]", "replace", {}), ("interface", "replace", 1), ("invariants", "replace", [CLAUSE] * 13)]:
        with pytest.raises(V.Unfit):
            V.patched(held, at, action, value)
    assert V.corrected_interface("f", {"signature": "stdin -> stdout", "input_channel": "stdin", "note": 1}) == {"class_name": None, "note": 1, "mode": "functional", "function_name": "f"}
    assert V.corrected_interface(None, {"mode": "functional"})["mode"] == "stdin_stdout"


def test_nested_and_mappings():
    assert jsonx.as_mapping("{'a': 1}") == {"a": 1} and jsonx.as_mapping("[1]") == {} and jsonx.as_mapping(None) == {}
    assert jsonx.without_keys({"a": [{"raw": 1, "b": 2}], "raw": 3}, {"raw"}) == {"a": [{"b": 2}]}
    assert jsonx.scan_object('{ open {"a": "}"} more') == '{"a": "}"}' and jsonx.scan_object("{" * 50_000) is None and jsonx.scan_object("") is None


def test_runs(spark):
    df = spark.createDataFrame([(1, 100, 50), (2, 140, 20), (3, 200, 10), (4, None, 10)], "id int, prompt int, output int")
    outcome, allowed = runs.context_budget(F.col("prompt"), F.col("output"), F.lit(150))
    got = df.select("id", outcome.alias("o"), allowed.alias("a"))
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, "fits", 50), (2, "clamped", 10), (3, "exceeds", None), (4, "unknown", None)]
    with pytest.raises(ValueError, match="context exceeded: 2, 3"):
        runs.require_budget(got, "o", "id")
    row = runs.provenance(spark, {"b": "1", "a": "x"}, spark.createDataFrame([("f", "00")], "file_path string, sha256 string")).first()
    assert row["settings"] == '{"a": "x", "b": "1"}' and row["n_files"] == 1 and row["generated_at"] is not None
    accounted = runs.accounting(spark.createDataFrame([("train",), (None,)], "split string"), "split", {"train": "train", "val": "validation"})
    with pytest.raises(ValueError, match="add up"):
        runs.require_balanced(accounted)


def test_results_of_tasks(spark):
    kinds = spark.createDataFrame([("no_tests", 0), ("odd", 2)], "kind string, n int").select(evaluation.failed_result(F.lit("t"), F.col("n"), F.col("kind")).alias("r")).select("r.*")
    assert [(r["failure_type"], r["passed"], r["tests_total"]) for r in kinds.orderBy("tests_total").collect()] == [("no_tests", False, 0), ("evaluator_error", False, 2)]
    rows = spark.createDataFrame([(["timeout", "passed", "compile_error", "timeout"], 4), (["passed"], 2), (["passed"], 1)], "o array<string>, n int")
    assert [r[0] for r in rows.select(evaluation.ordered_reasons(F.col("o"), F.col("n"))).collect()] == [["compile_error", "timeout"], ["incomplete_results"], []]


def test_split_is_that_of_one_window(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else "cold") for i in range(700)], "id int, stratum string")
    got = selection.stratified_split(rows, "stratum", "id", 0.1)
    sizes = {(r["stratum"], r["assigned"]): r["count"] for r in got.groupBy("stratum", "assigned").count().collect()}
    assert got.count() == 700 and {k: v for k, v in sizes.items() if k[1] == "val"} == {("hot", "val"): 47, (None, "val"): 12, ("cold", "val"): 12}


def test_encode_reasons(spark):
    good = [("system", "s"), ("user", "u"), ("assistant", "a")]
    cases = [
        (good, "p", "f", [1, 2], [1, 2, 3], None), (None, "p", "f", [1], [1, 2], "invalid_messages"), (good[:2], "p", "f", [1], [1, 2], "invalid_messages"), (good[:2] + [None], "p", "f", [1], [1, 2], "invalid_message_object"),
        (good[::-1], "p", "f", [1], [1, 2], "invalid_role_order"), ([("system", None)] + good[1:], "p", "f", [1], [1, 2], "non_string_message_content"), (good[:2] + [("assistant", " ")], "p", "f", [1], [1, 2], "empty_assistant_content"),
        (good, None, "f", [1], [1, 2], "invalid_prompt_template_output"), (good, "p", None, [1], [1, 2], "invalid_full_template_output"), (good, "p", "f", None, [1], "tokenization_error"), (good, "p", "f", [1], [], "empty_full_sequence"),
        (good, "p", "f", [9], [1, 2], "prompt_prefix_mismatch"), (good, "p", "f", [1, 2, 3], [1, 2], "empty_assistant_target"), (good, "p", "f", [1], [1, 2, 3, 4, 5, 6], "exceeds_max_length"), (good, "p", "f", [1], [1, -100], "empty_training_labels"),
    ]
    schema = "i int, messages array<struct<role: string, content: string>>, prompt string, full string, prompt_ids array<int>, full_ids array<int>"
    df = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], schema)
    reason = selection.encode_reason(*(F.col(c) for c in ("messages", "prompt", "full", "prompt_ids", "full_ids")), 5)
    marked = df.select("i", reason.alias("reason"))
    assert [r["reason"] for r in marked.orderBy("i").collect()] == [c[5] for c in cases]
    assert selection.without_rejected(marked, "reason", "i").count() == 1
    with pytest.raises(ValueError, match="fatal exceeds_max_length: 13"):
        selection.without_rejected(marked, "reason", "i", fatal=("exceeds_max_length",))
    with pytest.raises(ValueError, match="15 examples"):
        selection.require_examples(df, "messages", "i", 14)


def test_sinks_and_storage(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "id string, n int")
    sinks.write_kept_and_removed(rows, F.when(F.col("n").isNull(), "no_n"), f"{tmp_path}/kept", f"{tmp_path}/removed")
    assert spark.read.parquet(f"{tmp_path}/kept").count() == 1 and spark.read.parquet(f"{tmp_path}/removed").first()["reason"] == "no_n"
    sinks.write_evaluation(rows, rows.limit(1), f"{tmp_path}/eval")
    assert spark.read.json(f"{tmp_path}/eval/details").count() == 2 and spark.read.json(f"{tmp_path}/eval/summary").count() == 1

    with storage.released(spark):
        kept = storage.staged(rows, "rows")
        assert kept.count() == 2
        path = storage._PATHS[-1].removeprefix("file://")
        assert os.path.isdir(path)
    assert not os.path.exists(path)

    class Elsewhere:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Elsewhere)


def test_reports_and_actionable_issues():
    issue = V.semantic("vague_clause", "invariants[0]", "clarify", "x") | {"grounded": True}
    assert V.actionable([issue | {"grounded": False}, issue | {"location": "a.description"}, issue]) == issue and V.actionable([]) is None
    done = V.report("DEFECTIVE", "confirmed", V.analyse(None, None), issue)
    assert done["action"] == "REPAIR" and done["repair_issue"] == issue and V.report("CORRECT", "clean", ([], []))["action"] == "KEEP"
    with pytest.raises(V.Unfit):
        V.report("MAYBE", "", ([], []))


def test_http_backend_and_tries():
    import http.server
    import threading

    class Model(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            prompt = self.rfile.read(int(self.headers["Content-Length"])).decode()
            self.send_response(404 if "lost" in prompt else 500 if "down" in prompt else 200)
            self.end_headers()
            self.wfile.write(b'{"response": "fine"}')

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    model = backend.HttpBackend(f"http://127.0.0.1:{server.server_port}/")
    assert model.generate(["a", "b"]) == ["fine", "fine"]
    waits: list[float] = []
    with pytest.raises(backend.FatalError, match="404"):
        backend.with_retries(lambda: model.generate(["lost"]), 3, waits.append)
    assert waits == []
    with pytest.raises(OSError):
        backend.with_retries(lambda: model.generate(["down"]), 2, waits.append)
    assert waits == [1.0, 2.0]
    server.shutdown()
    answers = iter(["no", '{"decision": "REJECTED", "issue_index": null}'])
    got = backend.until_valid(lambda: next(answers), lambda text: V.read_answer(text, V.confirmation, 1))
    assert got["ok"] and got["calls"] == 2 and got["errors"] == ["confirmation is no object"]
    assert not backend.until_valid(lambda: "", lambda text: V.read_answer(text, V.confirmation, 1))["ok"]
    assert backend.stopped("a<end>b</s>", ["</s>", "<end>", ""]) == "a" and backend.stopped("abc", ["x"]) == "abc"
