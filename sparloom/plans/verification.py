"""Queries of the verifier, of resumed runs and of budgets, with their DuckDB oracles.

Rules that need a parser or read answers of any shape are shown on small inline
inputs with their expected rows (``GOLDEN``); everything else runs over whole tables.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparloom.functions import jsonx, text
from sparloom.operators import evaluation, runs, selection, verifier
from sparloom.plans.reference import VALID_SQL
from sparloom.sources import sinks
from sparloom.storage import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


def values(columns: str, rows: list[tuple]) -> str:
    """Expected rows as SQL."""
    shown = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS t({columns})"


# --- rules for expressions ---------------------------------------------------------------

EXPRESSIONS = [
    (1, "x > 0", ""), (2, "", "invalid_expression"), (3, "x = 1", "invalid_expression_syntax"), (4, "(y := x) > 0", "assignment_expression_not_allowed"),
    (5, "x == ...", "ellipsis_not_allowed"), (6, "print(x)", "side_effect_or_dynamic_call_not_allowed"), (7, "xs.sort() is None", "mutation_not_allowed_in_expression"),
    (8, "all(x > 0, y)", "invalid_all_any_argument"), (9, "any(True)", "invalid_all_any_argument"), (10, "all(y > 0 for x in xs)", "unused_quantified_variable_hint"),
    (11, "all(a == b for a, b in zip(xs, ys))", "zip_cardinality_review_hint"), (12, "[x]", "non_boolean_result"), (13, "1 if x else x > 2", "non_boolean_result"),
    (14, "x > 1 or 'no'", "non_boolean_result"), (15, "x + 1", ""), (16, "globals() == locals()", ""), (17, "all(x for ys in xs for x in ys)", ""),
    (18, "all('ab')", ""), (19, "True", ""), (20, None, "invalid_expression"), (21, "eval('xs.pop()') or xs.pop()", "side_effect_or_dynamic_call_not_allowed,mutation_not_allowed_in_expression"),
    (22, "lambda: 1", "non_boolean_result"), (23, "f(all(i for j in xs for k in j))", "unused_quantified_variable_hint"),
]


@query(values("n, codes", [(n, codes) for n, _, codes in EXPRESSIONS]))
def expression_rules(spark, sf_dir):
    """Codes of each kind of expression."""
    rows = spark.createDataFrame([(n, e) for n, e, _ in EXPRESSIONS], "n int, expression string")
    return rows.select("n", F.array_join(F.transform(verifier.expression_issues_udf("expression"), lambda i: i["code"]), ",").alias("codes"))


# --- contracts against their tasks -------------------------------------------------------

NAMES_SQL = "(SELECT task_id, max(nullif(trim(fn_name), '')) AS name FROM testing_data WHERE task_id IS NOT NULL GROUP BY 1)"


def _contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, contract and the function name of its task, null for a task that reads standard input."""
    names = table(spark, sf_dir, "testing_data").where("task_id IS NOT NULL").groupBy("task_id").agg(F.max(F.nullif(F.trim("fn_name"), F.lit(""))).alias("name"))
    return table(spark, sf_dir, "contract_record").select("record_id", "task_id", "contract").join(names, "task_id")


@query()
def contract_analysis(spark, sf_dir):
    """Semantic and representation issues of every contract, and what blocks it."""
    rows = _contracts(spark, sf_dir).select("record_id", verifier.analyse_udf("name", "contract").alias("a"))
    return rows.select(
        "record_id", F.array_join(F.transform("a.semantic", lambda i: F.concat_ws("@", i["type"], i["location"])), ",").alias("semantic"),
        F.array_join(F.transform("a.representation", lambda i: F.concat_ws("@", i["code"], i["location"])), ",").alias("representation"),
        F.array_join("a.blocking", ",").alias("blocking"),
    )


MODE_SQL = "CASE WHEN name IS NOT NULL THEN 'functional' ELSE 'stdin_stdout' END"
FACE_SQL = "json_extract_string(contract, '$.interface.{0}')"


@query(f"""WITH c AS (SELECT record_id, contract, name FROM contract_record JOIN {NAMES_SQL} USING (task_id) WHERE {VALID_SQL})
SELECT record_id, CASE WHEN coalesce(trim({FACE_SQL.format('mode')}) NOT IN ('functional', 'stdin_stdout'), true) THEN NULL
WHEN trim({FACE_SQL.format('mode')}) <> {MODE_SQL} THEN 'interface'
WHEN name IS NOT NULL AND coalesce({FACE_SQL.format('function_name')}, '') <> name THEN 'interface.function_name'
WHEN name IS NULL AND {FACE_SQL.format('signature')} <> 'stdin -> stdout' THEN 'interface.signature'
WHEN name IS NULL AND {FACE_SQL.format('input_channel')} <> 'stdin' THEN 'interface.input_channel'
WHEN name IS NULL AND {FACE_SQL.format('output_channel')} <> 'stdout' THEN 'interface.output_channel' END AS location FROM c""")
def interface_contradictions(spark, sf_dir):
    """The first way in which the interface of a contract contradicts its task."""
    rows = _contracts(spark, sf_dir).where(jsonx.is_object(F.col("contract")))
    return rows.select("record_id", verifier.interface_location(F.col("name"), F.col("contract")).alias("location"))


CLAUSE = {"id": "Q1", "expression": "x > 0", "description": "d"}
CONTRACTS = [
    (1, "f", {"interface": {"mode": "functional", "function_name": "f"}, "preconditions": [], "postconditions": [CLAUSE], "invariants": []}, "", "", ""),
    (2, "f", None, "", "contract_not_object@contract", ""),
    (3, None, {"interface": {"mode": "functional"}, "preconditions": [], "postconditions": [], "invariants": []}, "incorrect_clause@interface,missing_clause@postconditions", "", ""),
    (4, "f", {"interface": {"mode": "functional", "function_name": "g"}, "preconditions": [], "postconditions": [CLAUSE], "invariants": []}, "incorrect_clause@interface.function_name", "", ""),
    (5, None, {"interface": {"mode": "stdin_stdout", "signature": "f(x)", "output_channel": "file"}, "preconditions": [], "postconditions": [CLAUSE], "invariants": []},
     "incorrect_clause@interface.signature", "stdin_stdout_signature_mismatch@interface.signature,stdout_channel_mismatch@interface.output_channel", ""),
    (6, "f", {"interface": [], "postconditions": 1, "extra": 0}, "",
     "missing_top_level_keys@contract,extra_top_level_keys@contract,invalid_interface@interface,section_not_list@preconditions,section_not_list@postconditions,section_not_list@invariants", "invalid_interface,section_not_list"),
    (7, "f", {"interface": {"mode": "rpc"}, "preconditions": [{"id": "P1", "expression": "return_value > 0", "description": "d"}, "p"], "postconditions": [{"id": "X", "expression": "x", "note": 1}], "invariants": [{"id": 1, "expression": "[", "description": "d"}]}, "",
     "invalid_interface_mode@interface.mode,output_reference_in_precondition@preconditions[0],clause_not_object@preconditions[1],clause_keys_mismatch@postconditions[0],clause_id_prefix_mismatch@postconditions[0].id,"
     "invalid_description@postconditions[0].description,invalid_clause_id@invariants[0].id,invalid_expression_syntax@invariants[0].expression", "clause_not_object,invalid_expression_syntax,invalid_interface_mode"),
]


@query(values("n, semantic, representation, blocking", [(n, a, b, c) for n, _, _, a, b, c in CONTRACTS]))
def contract_rules(spark, sf_dir):
    """Issues of each kind of contract."""
    rows = spark.createDataFrame([(n, name, None if c is None else json.dumps(c)) for n, name, c, *_ in CONTRACTS], "n int, name string, contract string")
    found = rows.select("n", verifier.analyse_udf("name", "contract").alias("a"))
    return found.select(
        "n", F.array_join(F.transform("a.semantic", lambda i: F.concat_ws("@", i["type"], i["location"])), ",").alias("semantic"),
        F.array_join(F.transform("a.representation", lambda i: F.concat_ws("@", i["code"], i["location"])), ",").alias("representation"), F.array_join("a.blocking", ",").alias("blocking"),
    )


# --- answers about contracts -------------------------------------------------------------

ALL_OK = dict.fromkeys(verifier.CHECKS, "OK")
HELD = {"postconditions": [CLAUSE], "preconditions": [], "invariants": [], "interface": {}}
RAISED = {"type": "missing_clause", "location": "postconditions", "action": "add", "instruction": "State the order of the output.", "task_evidence": "In  Rising order"}
AUDITS = [
    (1, {"checks": ALL_OK, "issues": []}, "valid", 0, 0), (2, {"checks": ALL_OK | {"interface": "issue"}, "issues": []}, "valid", 0, 1), (3, [], "audit is no object", None, None),
    (4, {"checks": ALL_OK}, "audit needs exactly the keys checks, issues", None, None), (5, {"checks": ALL_OK | {"interface": "BAD"}, "issues": []}, "invalid interface check BAD", None, None),
    (6, {"checks": ALL_OK, "issues": [RAISED, RAISED]}, "valid", 1, 0), (7, {"checks": ALL_OK, "issues": [RAISED | {"task_evidence": "elsewhere"}]}, "valid", 1, 1),
    (8, {"checks": ALL_OK, "issues": [RAISED | {"action": "replace"}]}, "issue[0]: invalid action replace for missing_clause", None, None),
    (9, {"checks": ALL_OK, "issues": [RAISED | {"instruction": "Fix this clause."}]}, "issue[0]: instruction is too generic", None, None),
    (10, {"checks": ALL_OK, "issues": [RAISED | {"type": "incorrect_clause", "action": "remove", "location": "postconditions[0].description", "task_evidence": ""}]}, "valid", 1, 0),
    (11, {"checks": ALL_OK, "issues": [RAISED | {"type": "vague_clause", "action": "clarify", "location": "postconditions[1]"}]}, "issue[0]: invalid location postconditions[1]", None, None),
    (12, {"checks": ALL_OK, "issues": {}}, "issues are no list", None, None),
]


@query(values("n, outcome, issues, doubts", [(n, o, i, d) for n, _, o, i, d in AUDITS]))
def audit_answers(spark, sf_dir):
    """Audits in normal form, or why they do not follow the schema."""
    arguments = json.dumps(["Print them in rising order.", HELD])
    rows = spark.createDataFrame([(n, "Answer:\n```json\n" + json.dumps(a) + "\n```" if isinstance(a, dict) else json.dumps(a), arguments) for n, a, *_ in AUDITS], "n int, answer string, arguments string")
    read = rows.select("n", verifier.answer_udf(verifier.audit)("answer", "arguments").alias("r"))
    error = F.get_json_object("r", "$.error")
    return read.select(
        "n", F.coalesce(error, F.lit("valid")).alias("outcome"), F.json_array_length(F.get_json_object("r", "$.issues")).alias("issues"), F.json_array_length(F.get_json_object("r", "$.uncertainties")).alias("doubts")
    )


CONFIRMATIONS = [
    (1, '{"decision": "confirmed", "issue_index": 1}', "CONFIRMED"), (2, '{"decision": "CONFIRMED", "issue_index": 2}', "CONFIRMED needs the index of a candidate"),
    (3, '{"decision": "CONFIRMED", "issue_index": true}', "CONFIRMED needs the index of a candidate"), (4, '{"decision": "REJECTED", "issue_index": null}', "REJECTED"),
    (5, '{"decision": "UNCERTAIN", "issue_index": 0}', "UNCERTAIN needs no index"), (6, '{"decision": "maybe", "issue_index": null}', "invalid decision MAYBE"),
    (7, '{"decision": "REJECTED"}', "confirmation needs exactly the keys decision, issue_index"), (8, None, "confirmation is no object"),
]


@query(values("n, outcome", [(n, o) for n, _, o in CONFIRMATIONS]))
def confirmation_answers(spark, sf_dir):
    """Decisions of confirmations of one of two candidates."""
    rows = spark.createDataFrame([(n, a) for n, a, _ in CONFIRMATIONS], "n int, answer string")
    read = rows.select("n", verifier.answer_udf(verifier.confirmation)("answer", F.lit("[2]")).alias("r"))
    return read.select("n", F.coalesce(F.get_json_object("r", "$.error"), F.get_json_object("r", "$.decision")).alias("outcome"))


FOUR_OK = dict.fromkeys(sorted(verifier.REVIEW_CHECKS), "OK")
REVIEWS = [
    (1, {"checks": FOUR_OK, "explanation": "same meaning"}, "true"), (2, {"checks": FOUR_OK | {"target_correct": "ISSUE"}, "explanation": "wrong bound"}, "false"),
    (3, {"checks": FOUR_OK, "explanation": " "}, "an explanation is required"), (4, {"checks": {"target_correct": "OK"}, "explanation": "x"}, "checks needs exactly the keys change_supported, examples_consistent, obligations_preserved, target_correct"),
    (5, {"checks": FOUR_OK | {"target_correct": "ok"}, "explanation": "x"}, "invalid check"),
]


@query(values("n, outcome", [(n, o) for n, _, o in REVIEWS]))
def change_reviews(spark, sf_dir):
    """Whether the review of a change accepts it."""
    rows = spark.createDataFrame([(n, json.dumps(a)) for n, a, _ in REVIEWS], "n int, answer string")
    read = rows.select("n", verifier.answer_udf(verifier.change_review)("answer", F.lit("[]")).alias("r"))
    return read.select("n", F.coalesce(F.get_json_object("r", "$.error"), F.get_json_object("r", "$.accepted")).alias("outcome"))


# --- repairs -----------------------------------------------------------------------------

NEW = {"id": "Q9", "expression": "y > 1", "description": "e"}
PATCHES = [
    (1, "postconditions[0]", "replace", NEW, '[{"description": "e", "expression": "y > 1", "id": "Q1"}]'), (2, "postconditions[0].expression", "replace", NEW, '[{"description": "e", "expression": "y > 1", "id": "Q1"}]'),
    (3, "postconditions", "add", NEW, '[{"description": "d", "expression": "x > 0", "id": "Q1"}, {"description": "e", "expression": "y > 1", "id": "Q2"}]'), (4, "postconditions", "replace", [NEW, NEW], '[{"description": "e", "expression": "y > 1", "id": "Q1"}, {"description": "e", "expression": "y > 1", "id": "Q2"}]'),
    (5, "postconditions", "replace", [], None), (6, "postconditions[1]", "remove", None, None), (7, "postconditions[0]", "remove", None, "[]"), (8, "postconditions", "add", {"id": "Q1"}, None), (9, "elsewhere", "add", NEW, None),
    (10, "interface.mode", "replace", {"mode": "functional"}, '[{"description": "d", "expression": "x > 0", "id": "Q1"}]'), (11, "postconditions[0]", "replace", NEW | {"expression": "print(y)"}, None),
]


@query(values("n, postconditions", [(n, o) for n, *_, o in PATCHES]))
def location_patches(spark, sf_dir):
    """The postconditions of a contract after a patch, null where the patch does not fit."""
    rows = spark.createDataFrame([(n, json.dumps(HELD), at, action, json.dumps(v)) for n, at, action, v, _ in PATCHES], "n int, contract string, location string, action string, value string")
    done = rows.select("n", verifier.patched_udf("contract", "location", "action", "value").alias("c"))

    return done.select("n", verifier.member_udf("c", F.lit("postconditions")).alias("postconditions"))


TARGET_SQL = "CASE record_id % 3 WHEN 0 THEN 'interface.mode' WHEN 1 THEN 'postconditions[0].expression' ELSE 'preconditions[1]' END"


@query(f"""WITH t AS (SELECT record_id, {TARGET_SQL} AS location, row_number() OVER (PARTITION BY run_id, task_id, record_id % 3 ORDER BY ingested_at, record_id) AS attempt FROM contract_record)
SELECT record_id, attempt, CASE WHEN attempt < 3 OR location = 'interface.mode' THEN location ELSE split_part(location, '[', 1) END AS location FROM t""")
def section_fallbacks(spark, sf_dir):
    """Targets of repeated repairs: from the third attempt on one target, its whole section."""
    target = F.when(F.col("record_id") % 3 == 0, "interface.mode").when(F.col("record_id") % 3 == 1, "postconditions[0].expression").otherwise("preconditions[1]")
    rows = table(spark, sf_dir, "contract_record").select("record_id", "run_id", "task_id", "ingested_at", target.alias("location"))
    numbered = runs.tries(rows, ["run_id", "task_id", "location"], ["ingested_at", "record_id"])
    return numbered.select("record_id", "attempt", verifier.widened_location(F.col("location"), F.lit("replace"), F.col("attempt")).alias("location"))


@query("""SELECT record_id, md5(concat_ws(chr(10), 'TASK ID: ' || coalesce(task_id, 'unspecified'), '', 'CURRENT CONTRACT:', contract, '', 'REQUIRED INTERFACE:', CASE WHEN name IS NULL THEN 'stdin -> stdout' ELSE name END)) AS digest
FROM contract_record JOIN """ + NAMES_SQL + """ USING (task_id) WHERE contract IS NOT NULL""")
def audit_prompts(spark, sf_dir):
    """Prompts of the audit of a contract."""
    rows = _contracts(spark, sf_dir).where("contract IS NOT NULL")
    return rows.select("record_id", F.md5(verifier.audit_prompt(F.col("task_id"), F.col("contract"), F.col("name"))).alias("digest"))


# --- budgets, ids, calls, resumed runs ---------------------------------------------------


@query("""SELECT record_id, CASE WHEN prompt_tokens IS NULL THEN 'unknown' WHEN prompt_tokens + max_new_tokens_used <= 2048 THEN 'fits' WHEN prompt_tokens < 2048 THEN 'clamped' ELSE 'exceeds' END AS outcome,
CASE WHEN prompt_tokens < 2048 THEN least(max_new_tokens_used, 2048 - prompt_tokens) END AS allowed FROM code_record WHERE max_new_tokens_used IS NOT NULL""")
def context_budgets(spark, sf_dir):
    """Output tokens a prompt leaves in a context of 2,048."""
    rows = table(spark, sf_dir, "code_record").where("max_new_tokens_used IS NOT NULL")
    outcome, allowed = runs.context_budget(F.col("prompt_tokens"), F.col("max_new_tokens_used"), F.lit(2048))
    return rows.select("record_id", outcome.alias("outcome"), allowed.alias("allowed"))


BLANKS = r"'^\s+|\s+$'"


@query(f"""SELECT item_no, coalesce(nullif(regexp_replace(task_id, {BLANKS}, '', 'g'), ''), nullif(regexp_replace(prompt_hash, {BLANKS}, '', 'g'), '')) AS id FROM training_data""")
def trainer_ids(spark, sf_dir):
    """The id a row trains under: the first of two columns that is not blank, stripped."""
    return table(spark, sf_dir, "training_data").select("item_no", runs.first_text("task_id", "prompt_hash").alias("id"))


@query()
def call_formats(spark, sf_dir):
    """How each held-out task is to be called, from its own fields, then from its tests (JSON or Python literal)."""
    rows = table(spark, sf_dir, "testing_data")
    tests = jsonx.json_or_literal(F.col("input_output"))
    name = runs.first_text("fn_name", F.get_json_object(tests, "$.function_name"), F.get_json_object(tests, "$.fn_name"))
    described = verifier.call_format(name, runs.first_text(F.get_json_object(tests, "$.class_name")), runs.first_text(F.get_json_object(tests, "$.signature")), runs.first_text(F.get_json_object(tests, "$.mode")))
    return rows.select("item_no", described.alias("format"))


@query("""SELECT r.record_id, r.task_index, j.split_index AS expected FROM code_record r JOIN (SELECT task_id, min(split_index) AS split_index FROM testing_data WHERE task_id IS NOT NULL GROUP BY 1) j USING (task_id)
WHERE r.task_index IS NOT NULL AND r.task_index <> j.split_index""")
def index_conflicts(spark, sf_dir):
    """Records that carry another index than the job of their task."""
    jobs = table(spark, sf_dir, "testing_data").where("task_id IS NOT NULL").groupBy("task_id").agg(F.min("split_index").alias("expected"))
    return runs.index_conflicts(table(spark, sf_dir, "code_record").select("record_id", "task_id", "task_index"), jobs, "task_id", "task_index").select("record_id", "task_index", "expected")


@query(f"""SELECT r.record_id, coalesce(r.model = g.model AND r.seed = g.seed AND {VALID_SQL.replace('contract', 'r.contract')} AND regexp_matches(coalesce(r.generation_issue, ''), '^\\s*$'), false) AS complete
FROM contract_record r LEFT JOIN gen_run g USING (run_id)""")
def complete_outputs(spark, sf_dir):
    """Contract records that a resumed run may keep: of its own model and seed, an object, without an issue."""
    rows = table(spark, sf_dir, "contract_record").join(table(spark, sf_dir, "gen_run").select("run_id", F.col("model").alias("run_model"), F.col("seed").alias("run_seed")), "run_id", "left")
    same = runs.version_matches({"model": F.col("run_model"), "seed": F.col("run_seed")})
    return rows.select("record_id", (same & jsonx.is_object(F.col("contract")) & text.is_blank(F.col("generation_issue"))).alias("complete"))


@query("""SELECT run_id, sha256(concat_ws('|', coalesce(model, ''), coalesce(dataset, ''), coalesce(workflow, ''), coalesce(max_new_tokens::VARCHAR, ''), coalesce(seed::VARCHAR, ''))) AS fingerprint FROM gen_run""")
def run_fingerprints(spark, sf_dir):
    """Provenance of runs: one digest of all settings."""
    return table(spark, sf_dir, "gen_run").select("run_id", runs.fingerprint("model", "dataset", "workflow", "max_new_tokens", "seed").alias("fingerprint"))


@query("""SELECT schema_validation AS status, coalesce(generation_issue, 'none') AS issue, count(*) AS n, count(DISTINCT task_id) AS tasks, count(*) FILTER (parse_ok AND schema_ok) AS selected,
coalesce(sum(generated_tokens), 0)::BIGINT AS tokens FROM contract_record GROUP BY 1, 2""")
def verification_counters(spark, sf_dir):
    """Records, tasks, selected records and tokens by status and issue."""
    rows = table(spark, sf_dir, "contract_record")
    return rows.groupBy(F.col("schema_validation").alias("status"), F.coalesce("generation_issue", F.lit("none")).alias("issue")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("task_id").alias("tasks"), F.count_if(F.col("parse_ok") & F.col("schema_ok")).alias("selected"), F.coalesce(F.sum("generated_tokens"), F.lit(0)).alias("tokens")
    )


@query("""SELECT count(*) AS selected, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS validation, count(*) = count(*) FILTER (split IN ('train', 'val')) AS balanced FROM training_data""")
def split_accounting(spark, sf_dir):
    """Selected rows against the sum of both splits."""
    return runs.accounting(table(spark, sf_dir, "training_data"), "split", {"train": "train", "val": "validation"})


@query(r"""WITH f AS (SELECT file_path, regexp_replace(regexp_extract(file_path, '[^/]*$'), '\.[^.]*$', '') AS stem, content FROM raw_file WHERE regexp_matches(file_path, '/taco_[^/]*\.json$')),
k AS (SELECT DISTINCT file_path, coalesce(nullif(json_extract_string(content, '$.task_id'), ''), stem) AS key FROM f WHERE json_valid(content) AND json_type(content) = 'OBJECT')
SELECT key, count(*) AS n_files, count(*) > 1 AS repeated FROM k GROUP BY 1""")
def contract_index(spark, sf_dir):
    """Task files by stored id, else by stem; unreadable ones are left out, repeated keys are marked."""
    name = F.regexp_extract("file_path", r"[^/]*$", 0)
    files = table(spark, sf_dir, "raw_file").where(F.regexp_like(F.col("file_path"), F.lit(r"/taco_[^/]*\.json$"))).where(jsonx.is_object(F.col("content")))
    keyed = files.select("file_path", F.coalesce(F.nullif(F.get_json_object("content", "$.task_id"), F.lit("")), F.regexp_replace(name, r"\.[^.]*$", "")).alias("key")).distinct()
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n_files")).withColumn("repeated", F.col("n_files") > 1)


@query(r"SELECT record_id, md5(regexp_replace(code, '^\s+|\s+$', '', 'g')) AS digest FROM code_record WHERE regexp_matches(code, '\S')")
def loaded_code(spark, sf_dir):
    """Code that is not blank, stripped."""
    return table(spark, sf_dir, "code_record").where(~text.is_blank(F.col("code"))).select("record_id", F.md5(text.strip(F.col("code"))).alias("digest"))


@query("""SELECT item_no, CASE WHEN NOT coalesce(json_valid(input_output), false) OR least(json_array_length(input_output, '$.inputs'), json_array_length(input_output, '$.outputs')) IS NULL
OR json_array_length(input_output, '$.inputs') IS NULL OR json_array_length(input_output, '$.outputs') IS NULL THEN 'invalid_test_data'
WHEN least(json_array_length(input_output, '$.inputs'), json_array_length(input_output, '$.outputs')) = 0 THEN 'no_tests' WHEN question IS NULL OR trim(question) = '' THEN 'missing_code' END AS kind FROM testing_data""")
def unrun_tasks(spark, sf_dir):
    """Why a held-out task cannot be run, null if it can (its question stands for its code)."""
    return table(spark, sf_dir, "testing_data").select("item_no", evaluation.unrun_kind(F.col("input_output"), F.col("question")).alias("kind"))


# --- order, names and nested ids -----------------------------------------------------------


@query("SELECT item_no, row_number() OVER (ORDER BY md5('42|' || item_no), item_no) - 1 AS position FROM training_data")
def shuffled_rows(spark, sf_dir):
    """Rows in a seeded order of the whole table."""
    return selection.shuffled(table(spark, sf_dir, "training_data").select("item_no"), "item_no").select("item_no", "position")


NAMES = [("a/b",), ("a b",), ("a_b",), ("é",), ("ü",), ("_x",), ("plain",), ("plain",)]


@query(values("output_name, n_ids", [("a_b.json", 3), ("task.json", 2)]))
def clashing_names(spark, sf_dir):
    """Output names that several ids share."""
    return sinks.clashing_outputs(spark.createDataFrame(NAMES, "task_id string"), "task_id")


NESTED = [(1, "[1, 2, 3]", "1 2 3"), (2, "[[4, 5]]", "4 5"), (3, "[[[6]]]", "6"), (4, "[]", ""), (5, "[[]]", ""), (6, "[[1], [2]]", None), (7, None, None), (8, "7", None)]


@query(values("n, ids", [(n, ids) for n, _, ids in NESTED]))
def unwrapped_ids(spark, sf_dir):
    """Ids from lists nested in lists of one element; null for any other nesting."""
    rows = spark.createDataFrame([(n, t) for n, t, _ in NESTED], "n int, ids string")
    return rows.select("n", F.array_join(jsonx.unwrapped_ids(F.col("ids")), " ").alias("ids"))


ANSWERS = [
    (1, '{"a": 1}', '{"a": 1}'), (2, 'text ```json\n{"b": {"c": 2}}\n``` {"d": 3}', '{"b": {"c": 2}}'), (3, 'first { broken {"e": "}"} rest', '{"e": "}"}'), (4, "[1]", None), (5, None, None), (6, '[{"f": 1}]', '{"f": 1}'),
]


@query(values("n, found", [(n, o) for n, _, o in ANSWERS]))
def first_objects(spark, sf_dir):
    """The first JSON object inside an answer."""
    rows = spark.createDataFrame([(n, a) for n, a, _ in ANSWERS], "n int, answer string")
    return rows.select("n", jsonx.first_object_udf("answer").alias("found"))


RESPONSES = [
    (1, json.dumps(HELD), True), (2, "Sure:\n```json\n" + json.dumps({"contract": HELD}) + "\n```", True), (3, json.dumps(HELD).replace("x > 0", r"re.match('\d', x)"), True),
    (4, "<think>{" + json.dumps(HELD) + "</think>none", True), (5, json.dumps({"interface": {}}), False), (6, "", False), (7, None, False), (8, json.dumps(HELD)[:-1], False),
]


@query(values("n, recovered", [(n, int(o)) for n, _, o in RESPONSES]))
def recovered_responses(spark, sf_dir):
    """Whether a contract can be read from a response, as it stands or with its escapes repaired."""
    rows = spark.createDataFrame([(n, r) for n, r, _ in RESPONSES], "n int, response string")
    return rows.select("n", jsonx.find_contract_udf("response").isNotNull().cast("int").alias("recovered"))
