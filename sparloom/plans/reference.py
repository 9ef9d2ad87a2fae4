"""Queries of the contract and evaluation operators, with their DuckDB oracles.

Test outcomes are taken from ``lineitem``: an order is a task, its lines are
tests, and the return flag maps to an outcome (N passed, R logical_error, A
timeout). The pair (order, line number) repeats, so ordering goes on over part,
supplier, flag, price, quantity and ship date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from sparloom.functions import arrays, jsonx, text
from sparloom.operators import contracts, evaluation, runs, selection
from sparloom.sources import files, sinks
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


# --- test outcomes -> task results -> run results ---------------------------------

TEST_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice", "l_quantity", "l_shipdate"]
OUTCOME_SQL = "CASE l_returnflag WHEN 'N' THEN 'passed' WHEN 'R' THEN 'logical_error' ELSE 'timeout' END"
TESTS_SQL = f"""
tests AS (SELECT l_orderkey AS task, {OUTCOME_SQL} AS outcome,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(TEST_ORDER)}) AS i FROM lineitem),
stopped AS (SELECT * FROM (SELECT *, coalesce(sum(CASE WHEN outcome <> 'passed' THEN 1 ELSE 0 END)
  OVER (PARTITION BY task ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM tests) WHERE f = 0),
totals AS (SELECT task, count(*) AS tests_total FROM tests GROUP BY task),
ran AS (SELECT task, count(*) AS tests_run, count(*) FILTER (outcome = 'passed') AS tests_passed,
  arg_min(outcome, CASE outcome WHEN 'timeout' THEN 7 WHEN 'logical_error' THEN 8 ELSE 11 END) AS worst FROM stopped GROUP BY task),
results AS (SELECT o_orderkey AS task, coalesce(tests_total, 0) AS tests_total, coalesce(tests_run, 0) AS tests_run,
  coalesce(tests_passed, 0) AS tests_passed,
  coalesce(tests_total, 0) > 0 AND coalesce(tests_passed, 0) = coalesce(tests_total, 0) AS passed, worst
  FROM orders LEFT JOIN totals ON totals.task = o_orderkey LEFT JOIN ran ON ran.task = o_orderkey),
final AS (SELECT *, CASE WHEN tests_total = 0 THEN 'no_tests' WHEN NOT passed THEN worst END AS failure_type FROM results)
"""


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("l_returnflag") == "N", "passed").when(F.col("l_returnflag") == "R", "logical_error").otherwise("timeout")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"), *TEST_ORDER, outcome.alias("outcome"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"))
    return evaluation.task_results(_tests(spark, sf_dir), tasks, "task", TEST_ORDER)


@query(f"""WITH {TESTS_SQL} SELECT count(*) AS selected, count(*) FILTER (passed) AS passed,
round_even(count(*) FILTER (passed) / count(*), 6) AS pass_at_1, count(*) FILTER (tests_passed > 0) AS tasks_with_a_pass,
sum(tests_run)::BIGINT AS tests_run, sum(tests_passed)::BIGINT AS tests_passed, sum(tests_total)::BIGINT AS tests_total,
round_even(sum(tests_passed) / sum(tests_total), 6) AS test_pass_rate FROM final""")
def evaluation_summary(spark, sf_dir):
    return evaluation.run_summary(_results(spark, sf_dir))


@query(f"""WITH {TESTS_SQL} SELECT task, tests_total, tests_run, tests_passed, passed, failure_type,
round_even(coalesce(100 * tests_passed / nullif(tests_total, 0), 0), 4)::DOUBLE AS pass_percentage FROM final""")
def task_results(spark, sf_dir):
    return _results(spark, sf_dir)


@query(f"WITH {TESTS_SQL} SELECT failure_type, count(*) AS n FROM final WHERE failure_type IS NOT NULL GROUP BY 1")
def failure_counts(spark, sf_dir):
    return evaluation.failure_counts(_results(spark, sf_dir))


@query(f"""WITH {TESTS_SQL}, c AS (SELECT task, outcome, count(*) AS n FROM tests GROUP BY 1, 2)
SELECT task, string_agg(outcome || '=' || n, ',' ORDER BY outcome) AS outcomes FROM c GROUP BY 1""")
def outcome_histogram(spark, sf_dir):
    maps = evaluation.outcome_histogram(_tests(spark, sf_dir), "task")
    pairs = F.transform(F.map_entries("outcomes"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return maps.select("task", F.array_join(pairs, ",").alias("outcomes"))


@query(f"WITH {TESTS_SQL} SELECT task, count(*) AS n_run FROM stopped GROUP BY 1")
def early_stop(spark, sf_dir):
    return evaluation.early_stop(_tests(spark, sf_dir), "task", TEST_ORDER).groupBy("task").agg(F.count(F.lit(1)).alias("n_run"))


@query(f"""WITH {TESTS_SQL} SELECT task, string_agg(outcome, ',' ORDER BY m) AS reasons
FROM (SELECT task, outcome, min(i) AS m FROM tests WHERE outcome <> 'passed' GROUP BY 1, 2) GROUP BY 1""")
def failure_reasons(spark, sf_dir):
    """Failures of a task in order of first occurrence, each once."""
    firsts = _tests(spark, sf_dir).where("outcome <> 'passed'").groupBy("task", "outcome").agg(F.min(F.struct(*TEST_ORDER)).alias("first"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first", "outcome"))), lambda s: s["outcome"])
    return firsts.groupBy("task").agg(F.array_join(listed, ",").alias("reasons"))


@query("""SELECT code, CASE code WHEN 'true' THEN 'passed' WHEN 'false' THEN 'logical_error' WHEN '-1' THEN 'timeout' WHEN '-2' THEN 'compile_or_load_error'
WHEN '-3' THEN 'runtime_or_process_error' WHEN '-4' THEN 'compile_error' ELSE 'unknown_result' END AS outcome, count(*) AS n
FROM (SELECT CASE l_linenumber WHEN 1 THEN 'true' WHEN 2 THEN 'false' WHEN 3 THEN '-1' WHEN 4 THEN '-2' WHEN 5 THEN '-3' WHEN 6 THEN '-4' ELSE '?' END AS code FROM lineitem) GROUP BY 1, 2""")
def outcome_names(spark, sf_dir):
    codes = F.element_at(F.array(*map(F.lit, ["true", "false", "-1", "-2", "-3", "-4", "?"])), F.least(F.col("l_linenumber"), F.lit(7)))
    named = table(spark, sf_dir, "lineitem").select(codes.alias("code"))
    return named.select("code", evaluation.outcome_name(F.col("code")).alias("outcome")).groupBy("code", "outcome").agg(F.count(F.lit(1)).alias("n"))


# --- selection, splits, duplicates, leakage ---------------------------------------

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
DIFF_SQL = "translate(upper(" + STRIP.format("difficulty") + "), '- ', '__')"
DIFF_NAMED_SQL = f"CASE {DIFF_SQL} WHEN 'MEDIUMHARD' THEN 'MEDIUM_HARD' WHEN 'VERYHARD' THEN 'VERY_HARD' ELSE {DIFF_SQL} END"
REASON_SQL = f"""CASE WHEN task_id IS NULL OR {STRIP.format('task_id')} = '' OR task_id = 'None' THEN 'missing_task_id'
WHEN coalesce({DIFF_NAMED_SQL} NOT IN ('EASY','MEDIUM','MEDIUM_HARD','HARD','VERY_HARD'), true) THEN 'invalid_difficulty'
WHEN coalesce(number_of_test_cases, 0) < 5 THEN 'insufficient_tests'
WHEN coalesce(test_cases_passed / nullif(number_of_test_cases, 0), 0) < 0.75 THEN 'low_pass_ratio' END"""


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "training_data")


@query(f"SELECT coalesce({REASON_SQL}, 'selected') AS reason, count(*) AS n FROM training_data GROUP BY 1")
def selection_reasons(spark, sf_dir):
    reason = F.coalesce(selection.rejection(min_tests=5), F.lit("selected"))
    return _training(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT item_no, task_id, {DIFF_NAMED_SQL} AS difficulty FROM training_data WHERE ({REASON_SQL}) IS NULL")
def selected_rows(spark, sf_dir):
    return _training(spark, sf_dir).where(selection.rejection(min_tests=5).isNull()).select(
        "item_no", "task_id", text.normalize_difficulty(F.col("difficulty")).alias("difficulty")
    )


SPLIT_SQL = f"""s AS (SELECT item_no, {DIFF_NAMED_SQL} AS stratum FROM training_data WHERE ({REASON_SQL}) IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || item_no), item_no) AS rn, count(*) OVER (PARTITION BY stratum) AS n FROM s),
split AS (SELECT item_no, stratum, CASE WHEN rn <= CASE WHEN n <= 1 THEN 0 ELSE least(greatest(1, round_even(n * 0.1, 0)::BIGINT), n - 1) END THEN 'val' ELSE 'train' END AS assigned FROM r)"""


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = _training(spark, sf_dir).where(selection.rejection(min_tests=5).isNull()).select("item_no", text.normalize_difficulty(F.col("difficulty")).alias("stratum"))
    return selection.stratified_split(chosen, "stratum", "item_no")


@query(f"WITH {SPLIT_SQL} SELECT item_no, stratum, assigned FROM split")
def stratified_split(spark, sf_dir):
    return _split(spark, sf_dir).select("item_no", "stratum", "assigned")


@query(f"""WITH {SPLIT_SQL} SELECT stratum, count(*) AS selected, count(*) FILTER (assigned = 'train') AS train,
count(*) FILTER (assigned = 'val') AS validation FROM split GROUP BY 1""")
def split_counts(spark, sf_dir):
    return _split(spark, sf_dir).groupBy("stratum").agg(
        F.count(F.lit(1)).alias("selected"), F.count_if(F.col("assigned") == "train").alias("train"), F.count_if(F.col("assigned") == "val").alias("validation")
    )


@query("""SELECT task_id FROM training_data WHERE split = 'train' AND task_id IS NOT NULL
INTERSECT SELECT task_id FROM training_data WHERE split = 'val' AND task_id IS NOT NULL""")
def train_val_shared_ids(spark, sf_dir):
    rows = _training(spark, sf_dir)
    return selection.shared_keys(rows.where("split = 'train'"), rows.where("split = 'val'"), "task_id")


@query("""SELECT lower(trim(prompt_hash)) AS h FROM training_data WHERE split = 'train' AND trim(prompt_hash) <> ''
INTERSECT SELECT lower(trim(prompt_hash)) FROM training_data WHERE split = 'val' AND trim(prompt_hash) <> ''""")
def train_val_shared_hashes(spark, sf_dir):
    rows = _training(spark, sf_dir).select("split", F.nullif(F.lower(F.trim("prompt_hash")), F.lit("")).alias("h"))
    return selection.shared_keys(rows.where("split = 'train'"), rows.where("split = 'val'"), "h")


@query("""SELECT t.split AS split, count(*) AS n FROM training_data t WHERE t.task_id IN (SELECT task_id FROM testing_data WHERE task_id IS NOT NULL
UNION SELECT task_id FROM probe_task) GROUP BY 1""")
def evaluation_leakage(spark, sf_dir):
    held_out = table(spark, sf_dir, "testing_data").select("task_id").union(table(spark, sf_dir, "probe_task").select("task_id"))
    return _training(spark, sf_dir).join(held_out, "task_id", "left_semi").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT task_id, item_no, occurrence FROM (SELECT task_id, item_no, row_number() OVER (PARTITION BY task_id ORDER BY item_no) AS occurrence
FROM training_data WHERE task_id IS NOT NULL) WHERE occurrence > 1""")
def duplicate_ids(spark, sf_dir):
    return selection.duplicates(_training(spark, sf_dir), "task_id", "item_no").withColumn("occurrence", F.col("occurrence").cast("long"))


@query("""SELECT item_no, number_of_test_cases AS n, test_cases_passed AS p, round_even(coalesce(p / nullif(n, 0), 0), 4)::DOUBLE AS ratio,
round_even(coalesce(100 * p / nullif(n, 0), 0), 4)::DOUBLE AS percentage FROM training_data""")
def pass_ratios(spark, sf_dir):
    n, p = F.col("number_of_test_cases"), F.col("test_cases_passed")
    return _training(spark, sf_dir).select(
        "item_no", n.alias("n"), p.alias("p"), arrays.rounded(arrays.ratio(p, n), 4).alias("ratio"), arrays.rounded(arrays.ratio(100 * p, n), 4).alias("percentage")
    )


# --- text ------------------------------------------------------------------------


@query(r"""SELECT item_no, md5(regexp_replace(regexp_replace(original_prompt, '[\x{200B}\x{FEFF}]', '', 'g'), '\p{Zs}', ' ', 'g')) AS h FROM training_data""")
def normalized_prompts(spark, sf_dir):
    return _training(spark, sf_dir).select("item_no", F.md5(text.normalize_prompt(F.col("original_prompt"))).alias("h"))


@query(f"SELECT {DIFF_NAMED_SQL} AS difficulty, count(*) AS n FROM training_data GROUP BY 1")
def difficulties(spark, sf_dir):
    return _training(spark, sf_dir).groupBy(text.normalize_difficulty(F.col("difficulty")).alias("difficulty")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT file_id, coalesce(nullif(regexp_replace(regexp_replace(file_path, '[^A-Za-z0-9_.\-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'task') || '.json' AS output_name FROM code_file""")
def output_names(spark, sf_dir):
    return table(spark, sf_dir, "code_file").select("file_id", sinks.output_name(F.col("file_path")).alias("output_name"))


@query(r"""WITH n AS (SELECT DISTINCT file_path, coalesce(nullif(regexp_replace(regexp_replace(file_path, '[^A-Za-z0-9_.\-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'task') || '.json' AS output_name FROM raw_file)
SELECT output_name, count(*) AS n_ids FROM n GROUP BY 1 HAVING count(*) > 1 OR starts_with(output_name, '_')""")
def clashing_outputs(spark, sf_dir):
    return sinks.clashing_outputs(table(spark, sf_dir, "raw_file"), "file_path")


@query(r"""SELECT record_id, md5(regexp_replace(CASE WHEN regexp_matches(raw_response, '(?is)```[a-z0-9_+-]*[ \t]*\r?\n(.*?)```')
THEN regexp_extract(raw_response, '(?is)```[a-z0-9_+-]*[ \t]*\r?\n(.*?)```', 1) ELSE regexp_replace(raw_response, '(?i)\[/?PYTHON\]', '', 'g') END, '^[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g')) AS h
FROM code_record WHERE raw_response IS NOT NULL""")
def first_fences(spark, sf_dir):
    rows = table(spark, sf_dir, "code_record").where(F.col("raw_response").isNotNull())
    return rows.select("record_id", F.md5(text.first_fence(F.col("raw_response"))).alias("h"))


@query(r"""WITH p AS (SELECT record_id, regexp_replace(raw_response, '(?i)\[/?PYTHON\]|</?python>', '', 'g') AS t FROM code_record WHERE raw_response IS NOT NULL),
b AS (SELECT record_id, t, regexp_extract_all(t, '(?is)```(?:python3|python|py)[ \t]*\r?\n(.*?)```', 1) AS py, regexp_extract_all(t, '(?is)```[a-z0-9_+-]*[ \t]*\r?\n(.*?)```', 1) AS anyb FROM p),
c AS (SELECT record_id, CASE WHEN len(py) > 0 THEN list_reduce(py, lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END)
WHEN len(anyb) > 0 THEN list_reduce(anyb, lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END) ELSE regexp_replace(t, '```[A-Za-z0-9_+-]*', '', 'g') END AS code FROM b)
SELECT record_id, md5(regexp_replace(code, '^[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g')) AS h FROM c""")
def longest_fences(spark, sf_dir):
    rows = table(spark, sf_dir, "code_record").where(F.col("raw_response").isNotNull())
    return rows.select("record_id", F.md5(text.longest_fence(F.col("raw_response"))).alias("h"))


@query()
def unwrapped_fences(spark, sf_dir):
    """Needs a look-ahead, which DuckDB's patterns lack."""
    rows = table(spark, sf_dir, "contract_record").where(F.col("raw_response").isNotNull())
    return rows.select("record_id", F.md5(text.unwrap_fence(F.col("raw_response"))).alias("h"))


@query(r"""SELECT record_id, CASE WHEN contains(raw_response, '</think>') THEN length(trim(split_part(raw_response, '</think>', -1), ' ' || chr(10) || chr(9) || chr(13)))
WHEN contains(raw_response, '<think>') THEN 0 ELSE length(trim(raw_response, ' ' || chr(10) || chr(9) || chr(13))) END AS n_chars
FROM contract_record WHERE raw_response IS NOT NULL""")
def after_reasoning(spark, sf_dir):
    rows = table(spark, sf_dir, "contract_record").where(F.col("raw_response").isNotNull())
    return rows.select("record_id", F.length(text.after_reasoning(F.col("raw_response"))).cast("long").alias("n_chars"))


@query("""SELECT item_no, md5(concat_ws(chr(10), 'Task:', question, CASE WHEN fn_name IS NULL THEN 'Read from standard input and write to standard output.'
ELSE 'Write the function ' || fn_name || '.' END)) AS h FROM testing_data""")
def prompts(spark, sf_dir):
    """Prompt of a task: functional tasks name their function, others use the standard streams."""
    how = F.when(F.col("fn_name").isNull(), "Read from standard input and write to standard output.").otherwise(F.concat(F.lit("Write the function "), F.col("fn_name"), F.lit(".")))
    return table(spark, sf_dir, "testing_data").select("item_no", F.md5(text.prompt(F.lit("Task:"), F.col("question"), how)).alias("h"))


@query("SELECT record_id, right(raw_response, 1200) AS last_part FROM contract_record WHERE raw_response IS NOT NULL AND parse_ok IS NOT TRUE")
def failed_tails(spark, sf_dir):
    """End of each response that did not parse, as shown to the next try."""
    rows = table(spark, sf_dir, "contract_record").where(F.col("raw_response").isNotNull() & ~F.coalesce("parse_ok", F.lit(False)))
    return rows.select("record_id", text.tail(F.col("raw_response"), 1200).alias("last_part"))


@query("""SELECT run_id, task_id, record_id, attempt, (['direct', 'minimal_edit', 'restate', 'split_clauses', 'rebuild_section'])[((attempt - 1) % 5 + 1)::INT] AS strategy
FROM (SELECT run_id, task_id, record_id, row_number() OVER (PARTITION BY run_id, task_id ORDER BY record_id) AS attempt FROM contract_record)""")
def attempts(spark, sf_dir):
    """Running number of tries for a task of a run, with the strategy in turn."""
    w = W.partitionBy("run_id", "task_id").orderBy("record_id")
    rows = table(spark, sf_dir, "contract_record").select("run_id", "task_id", "record_id", F.row_number().over(w).cast("long").alias("attempt"))
    return rows.withColumn("strategy", text.strategy(F.col("attempt")))


@query("""SELECT run_id, record_id, coalesce(string_agg(p, ',' ORDER BY i), '') AS before FROM (
SELECT a.run_id, a.record_id, b.record_id AS p, b.i FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY record_id) AS i FROM contract_record) a
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY record_id) AS i FROM contract_record) b ON a.run_id = b.run_id AND b.i BETWEEN a.i - 4 AND a.i - 1) GROUP BY 1, 2""")
def last_attempts(spark, sf_dir):
    """The four records before each record of a run."""
    w = W.partitionBy("run_id").orderBy("record_id").rowsBetween(-4, -1)
    return table(spark, sf_dir, "contract_record").select("run_id", "record_id", F.concat_ws(",", F.collect_list(F.col("record_id").cast("string")).over(w)).alias("before"))


# --- identity, questions, interfaces ----------------------------------------------


@query("""SELECT item_no, CASE WHEN task_id IS NOT NULL AND trim(task_id) <> '' AND task_id <> 'None' THEN task_id
WHEN split IS NOT NULL AND split_index IS NOT NULL THEN 'taco_' || split || '_' || split_index ELSE 'taco_' || item_no END AS task_key FROM testing_data""")
def task_keys(spark, sf_dir):
    """Stored id, else one made of split and index, else of the row number."""
    key = (
        F.when(~selection.absent(F.col("task_id")), F.col("task_id"))
        .when(F.col("split").isNotNull() & F.col("split_index").isNotNull(), F.concat(F.lit("taco_"), "split", F.lit("_"), F.col("split_index").cast("string")))
        .otherwise(F.concat(F.lit("taco_"), F.col("item_no").cast("string")))
    )
    return table(spark, sf_dir, "testing_data").select("item_no", key.alias("task_key"))


@query("""SELECT item_no, length(trim(question, ' ' || chr(10) || chr(9) || chr(13))) AS n_chars, coalesce(nullif(trim(fn_name), ''),
CASE WHEN json_valid(input_output) THEN json_extract_string(input_output, '$.fn_name') END) AS function_name FROM testing_data""")
def questions(spark, sf_dir):
    stored = F.when(jsonx.is_object(F.col("input_output")), F.get_json_object("input_output", "$.fn_name"))
    return table(spark, sf_dir, "testing_data").select(
        "item_no", F.length(text.strip(F.col("question"))).cast("long").alias("n_chars"),
        F.coalesce(F.nullif(F.trim("fn_name"), F.lit("")), stored).alias("function_name"),
    )


@query("""SELECT item_no, least(json_array_length(input_output, '$.inputs'), json_array_length(input_output, '$.outputs'))::BIGINT AS n_tests
FROM testing_data WHERE json_valid(input_output)""")
def test_counts(spark, sf_dir):
    """Tests of a task whose tests are JSON: as many as there are pairs."""
    v = F.try_parse_json("input_output")
    size = lambda k: F.size(F.try_variant_get(v, f"$.{k}", "array<variant>"))
    return table(spark, sf_dir, "testing_data").where(jsonx.is_object(F.col("input_output"))).select("item_no", F.least(size("inputs"), size("outputs")).cast("long").alias("n_tests"))


@query()
def parsed_tests(spark, sf_dir):
    """Tests of all tasks; Python literals need the scanner UDF."""
    rows = table(spark, sf_dir, "testing_data").select("item_no", jsonx.json_or_literal(F.col("input_output")).alias("io"))
    size = lambda k: F.json_array_length(F.get_json_object("io", f"$.{k}"))
    return rows.select("item_no", F.least(size("inputs"), size("outputs")).cast("long").alias("n_tests"), F.md5("io").alias("h"))


@query("""SELECT item_no, contract.interface.mode AS mode, CASE WHEN contract.interface.mode = 'stdin_stdout' THEN 'stdin -> stdout'
ELSE coalesce(nullif(trim(contract.interface.signature), ''), contract.interface.function_name) END AS signature FROM training_data WHERE contract IS NOT NULL""")
def interfaces(spark, sf_dir):
    face = F.col("contract.interface")
    signature = F.when(face["mode"] == "stdin_stdout", "stdin -> stdout").otherwise(F.coalesce(F.nullif(F.trim(face["signature"]), F.lit("")), face["function_name"]))
    return _training(spark, sf_dir).where("contract IS NOT NULL").select("item_no", face["mode"].alias("mode"), signature.alias("signature"))


# --- contracts -------------------------------------------------------------------

KEYS_SQL = "['interface', 'invariants', 'postconditions', 'preconditions']"
VALID_SQL = "(json_valid(contract) AND json_type(contract) = 'OBJECT')"


@query(f"""SELECT record_id, {VALID_SQL} AS is_object, CASE WHEN {VALID_SQL} THEN list_sort(json_keys(contract)) = {KEYS_SQL} ELSE false END AS exact_keys
FROM contract_record WHERE contract IS NOT NULL""")
def contract_shapes(spark, sf_dir):
    c = F.col("contract")
    return table(spark, sf_dir, "contract_record").where(c.isNotNull()).select("record_id", jsonx.is_object(c).alias("is_object"), jsonx.has_exact_keys(c).alias("exact_keys"))


@query(f"""SELECT record_id, array_to_string(list_sort(list_filter({KEYS_SQL}, lambda k: NOT list_contains(json_keys(contract), k))), ',') AS missing,
array_to_string(list_sort(list_filter(json_keys(contract), lambda k: NOT list_contains({KEYS_SQL}, k))), ',') AS extra FROM contract_record WHERE contract IS NOT NULL AND {VALID_SQL}""")
def contract_key_differences(spark, sf_dir):
    c = F.col("contract")
    rows = table(spark, sf_dir, "contract_record").where(c.isNotNull() & jsonx.is_object(c))
    return rows.select("record_id", F.array_join(jsonx.missing_keys(c), ",").alias("missing"), F.array_join(jsonx.extra_keys(c), ",").alias("extra"))


@query()
def recovered_contracts(spark, sf_dir):
    """Contracts found inside responses, with chatter, fences and reasoning around
    them, and their fingerprint; whole JSON texts take the native path first."""
    r = F.col("raw_response")
    native = jsonx.canonical_contract(r)
    rows = table(spark, sf_dir, "contract_record").where(r.isNotNull()).select("record_id", native.alias("native"), "raw_response")
    found = rows.select("record_id", F.coalesce("native", jsonx.find_contract_udf(F.when(F.col("native").isNull(), r))).alias("contract"))
    return found.select("record_id", jsonx.fingerprint_udf(F.col("contract")).alias("fingerprint"))


ISSUES_SQL = r"""
c AS (SELECT item_no, contract, contract.interface AS f FROM training_data),
cl AS (SELECT item_no, 'preconditions' AS s, 'P' AS l, unnest(contract.preconditions) AS x, unnest(range(len(contract.preconditions))) AS i FROM c WHERE contract IS NOT NULL
UNION ALL SELECT item_no, 'postconditions', 'Q', unnest(contract.postconditions), unnest(range(len(contract.postconditions))) FROM c WHERE contract IS NOT NULL
UNION ALL SELECT item_no, 'invariants', 'I', unnest(contract.invariants), unnest(range(len(contract.invariants))) FROM c WHERE contract IS NOT NULL),
issues AS (
SELECT item_no, 'missing_contract' AS type, 'contract' AS location FROM c WHERE contract IS NULL
UNION ALL SELECT item_no, 'missing_interface', 'interface' FROM c WHERE contract IS NOT NULL AND f IS NULL
UNION ALL SELECT item_no, 'invalid_mode', 'interface.mode' FROM c WHERE f IS NOT NULL AND coalesce(f.mode NOT IN ('functional', 'stdin_stdout'), true)
UNION ALL SELECT item_no, 'missing_function_name', 'interface.function_name' FROM c WHERE f.mode = 'functional' AND coalesce(trim(f.function_name), '') = ''
UNION ALL SELECT item_no, 'invalid_signature', 'interface.signature' FROM c WHERE f.mode = 'stdin_stdout' AND coalesce(f.signature <> 'stdin -> stdout', true)
UNION ALL SELECT item_no, 'invalid_channels', 'interface' FROM c WHERE f.mode = 'stdin_stdout' AND coalesce(f.input_channel <> 'stdin' OR f.output_channel <> 'stdout', true)
UNION ALL SELECT item_no, 'missing_clause', 'postconditions' FROM c WHERE contract IS NOT NULL AND coalesce(len(contract.postconditions), 0) = 0
UNION ALL SELECT item_no, 'missing_id', s || '[' || i || ']' FROM cl WHERE coalesce(trim(x.id), '') = ''
UNION ALL SELECT item_no, 'wrong_id_letter', s || '[' || i || ']' FROM cl WHERE trim(x.id) <> '' AND NOT starts_with(x.id, l)
UNION ALL SELECT item_no, 'id_out_of_sequence', s || '[' || i || ']' FROM cl WHERE starts_with(x.id, l) AND x.id <> l || (i + 1)
UNION ALL SELECT item_no, 'missing_expression', s || '[' || i || ']' FROM cl WHERE coalesce(trim(x.expression), '') = ''
UNION ALL SELECT item_no, 'missing_description', s || '[' || i || ']' FROM cl WHERE coalesce(trim(x.description), '') = ''
UNION ALL SELECT item_no, 'output_in_precondition', s || '[' || i || ']' FROM cl WHERE s = 'preconditions' AND regexp_matches(x.expression, '\b(?:stdout|return_value|result|output)\b'))
"""


@query(f"WITH {ISSUES_SQL} SELECT item_no, type, location FROM issues")
def contract_issues(spark, sf_dir):
    rows = _training(spark, sf_dir).select("item_no", F.explode(contracts.structure_issues(F.col("contract"))).alias("i"))
    return rows.select("item_no", "i.type", "i.location")


@query(f"WITH {ISSUES_SQL} SELECT type, count(*) AS n, count(DISTINCT item_no) AS contracts FROM issues GROUP BY 1")
def contract_issue_counts(spark, sf_dir):
    rows = _training(spark, sf_dir).select("item_no", F.explode(F.transform(contracts.structure_issues(F.col("contract")), lambda i: i["type"])).alias("type"))
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_no").alias("contracts"))


@query()
def expression_issues(spark, sf_dir):
    """Faults of clause expressions; they need a Python parser."""
    return contracts.expression_issues(_training(spark, sf_dir), "contract", "item_no")


@query("""SELECT item_no, i, contains(lower(regexp_replace(trim(original_prompt, ' ' || chr(10) || chr(9) || chr(13)), '\\s+', ' ', 'g')),
lower(regexp_replace(trim(d, ' ' || chr(10) || chr(9) || chr(13)), '\\s+', ' ', 'g'))) AND trim(d) <> '' AS grounded FROM (
SELECT item_no, original_prompt, unnest(contract.postconditions).description AS d, unnest(range(len(contract.postconditions)))::INT AS i FROM training_data WHERE contract IS NOT NULL)
WHERE original_prompt IS NOT NULL AND d IS NOT NULL""".replace("\\\\", "\\"))
def grounded_clauses(spark, sf_dir):
    """Whether the description of a postcondition is quoted from the task."""
    rows = _training(spark, sf_dir).select("item_no", "original_prompt", F.posexplode("contract.postconditions").alias("i", "c"))
    rows = rows.where(F.col("original_prompt").isNotNull() & F.col("c.description").isNotNull())
    return rows.select("item_no", "i", contracts.grounded(F.col("c.description"), F.col("original_prompt")).alias("grounded"))


@query("""SELECT item_no, len(contract.postconditions) AS n, 'postconditions[' || (item_no % 4) || ']' AS location,
coalesce((item_no % 4) < len(contract.postconditions), false) AS valid FROM training_data WHERE contract IS NOT NULL""")
def clause_locations(spark, sf_dir):
    """Whether a clause location exists (the location is made of the row's number)."""
    where = F.concat(F.lit("postconditions["), (F.col("item_no") % 4).cast("string"), F.lit("]"))
    return _training(spark, sf_dir).where("contract IS NOT NULL").select(
        "item_no", F.size("contract.postconditions").cast("long").alias("n"), where.alias("location"), contracts.location_valid(where, F.col("contract")).alias("valid")
    )


@query("""SELECT item_no, array_to_string(list_transform(range(least(len(contract.postconditions), 12)), lambda i: 'Q' || (i + 1)), ',') AS ids FROM training_data WHERE contract.postconditions IS NOT NULL""")
def renumbered_clauses(spark, sf_dir):
    clauses = contracts.renumbered(F.col("contract.postconditions"), "Q")
    return _training(spark, sf_dir).where("contract.postconditions IS NOT NULL").select("item_no", F.array_join(F.transform(clauses, lambda c: c["id"]), ",").alias("ids"))


# --- runs ------------------------------------------------------------------------


@query("""SELECT t.item_no, t.task_id, coalesce(c.n, 0) AS n_records, CASE WHEN c.task_id IS NULL THEN 'missing_code' ELSE 'ok' END AS status
FROM testing_data t LEFT JOIN (SELECT task_id, count(*) AS n FROM code_record WHERE trim(coalesce(code, '')) <> '' GROUP BY 1) c USING (task_id)""")
def tasks_with_code(spark, sf_dir):
    code = table(spark, sf_dir, "code_record").where(F.trim("code") != "").groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))
    joined = runs.with_results(table(spark, sf_dir, "testing_data").select("item_no", "task_id"), code, "task_id", F.lit("missing_code"))
    return joined.select("item_no", "task_id", F.coalesce("n", F.lit(0)).alias("n_records"), "status")


@query("""SELECT DISTINCT task_id FROM testing_data WHERE task_id IS NOT NULL AND task_id NOT IN (SELECT task_id FROM contract_record WHERE contract IS NOT NULL AND task_id IS NOT NULL)""")
def tasks_without_contract(spark, sf_dir):
    contracts_ = table(spark, sf_dir, "contract_record").where("contract IS NOT NULL").select("task_id")
    return table(spark, sf_dir, "testing_data").where("task_id IS NOT NULL").select("task_id").distinct().join(contracts_, "task_id", "left_anti")


@query("SELECT DISTINCT task_id FROM testing_data WHERE task_id IS NOT NULL AND task_id NOT IN (SELECT task_id FROM contract_record WHERE task_id IS NOT NULL) ORDER BY 1 LIMIT 20")
def first_unmatched(spark, sf_dir):
    """The first twenty ids for an error message (a top-k report)."""
    have = table(spark, sf_dir, "contract_record").select("task_id")
    return table(spark, sf_dir, "testing_data").where("task_id IS NOT NULL").select("task_id").distinct().join(have, "task_id", "left_anti").orderBy("task_id").limit(20)


@query("""SELECT r.run_id, t.task_id FROM gen_run r JOIN (SELECT DISTINCT run_id, task_id FROM contract_record) t USING (run_id)
WHERE NOT EXISTS (SELECT 1 FROM contract_record d WHERE d.run_id = r.run_id AND d.task_id = t.task_id AND regexp_matches(d.raw_response, '\\S') AND NOT regexp_matches(coalesce(d.generation_issue, ''), '\\S'))""".replace("\\\\", "\\"))
def remaining_contracts(spark, sf_dir):
    records = table(spark, sf_dir, "contract_record")
    jobs = table(spark, sf_dir, "gen_run").select("run_id").join(records.select("run_id", "task_id").distinct(), "run_id")
    return runs.remaining(jobs, records, ["run_id", "task_id"], runs.finished_response())


@query("""SELECT DISTINCT run_id, task_id FROM code_record a WHERE NOT EXISTS (SELECT 1 FROM code_record d WHERE d.run_id = a.run_id AND d.task_id = a.task_id
AND regexp_matches(d.code, '\\S') AND NOT regexp_matches(coalesce(d.generation_issue, ''), '\\S'))""".replace("\\\\", "\\"))
def remaining_code(spark, sf_dir):
    records = table(spark, sf_dir, "code_record").select("run_id", "task_id", "code", "generation_issue")
    return runs.remaining(records.select("run_id", "task_id").distinct(), records, ["run_id", "task_id"], runs.finished_code())


@query("""SELECT run_id, count(*) AS saved, count(*) FILTER (parse_ok) AS parsed, count(*) FILTER (schema_ok) AS schema_ok, count(*) FILTER (hit_output_limit) AS limit_hits,
count(*) FILTER (time_budget_reached) AS over_time,
round_even(sum(CASE WHEN isnan(generation_seconds) THEN 0 ELSE coalesce(generation_seconds, 0) END::DECIMAL(20,6))::DOUBLE, 3) AS seconds FROM contract_record GROUP BY 1""")
def contract_run_counters(spark, sf_dir):
    flags = {"parsed": F.col("parse_ok"), "schema_ok": F.col("schema_ok"), "limit_hits": F.col("hit_output_limit"), "over_time": F.col("time_budget_reached")}
    return runs.counters(table(spark, sf_dir, "contract_record"), ["run_id"], flags, "generation_seconds")


@query("""SELECT workflow, model, count(*) AS saved, count(*) FILTER (regexp_matches(code, '\\S')) AS with_code, count(*) FILTER (regexp_matches(generation_issue, '\\S')) AS failed,
round_even(sum(CASE WHEN isnan(generation_seconds) THEN 0 ELSE coalesce(generation_seconds, 0) END::DECIMAL(20,6))::DOUBLE, 3) AS seconds FROM code_record GROUP BY 1, 2""".replace("\\\\", "\\"))
def code_run_counters(spark, sf_dir):
    flags = {"with_code": ~text.is_blank(F.col("code")), "failed": ~text.is_blank(F.col("generation_issue"))}
    return runs.counters(table(spark, sf_dir, "code_record"), ["workflow", "model"], flags, "generation_seconds")


@query("""SELECT model, count(*) AS n, min(generated_tokens) AS shortest, trunc(median(generated_tokens))::BIGINT AS median,
(list(generated_tokens ORDER BY generated_tokens))[greatest(1, floor(count(*) * 0.95))::INT] AS p95, max(generated_tokens) AS longest
FROM code_record WHERE generated_tokens IS NOT NULL GROUP BY 1""")
def token_lengths(spark, sf_dir):
    return runs.length_summary_exact(table(spark, sf_dir, "code_record").select("model", "generated_tokens"), "model", "generated_tokens")


@query("""SELECT record_id, round_even(generated_tokens / nullif(CASE WHEN isnan(generation_seconds) THEN NULL ELSE generation_seconds END, 0), 3)::DOUBLE AS tokens_per_second
FROM contract_record""")
def token_rates(spark, sf_dir):
    seconds = F.nanvl("generation_seconds", F.lit(None).cast("double"))
    return table(spark, sf_dir, "contract_record").select("record_id", F.bround(F.try_divide(F.col("generated_tokens"), seconds), 3).alias("tokens_per_second"))


@query("SELECT item_no, row_number() OVER (ORDER BY item_no) - 1 AS task_index FROM testing_data")
def task_numbers(spark, sf_dir):
    """Contiguous numbers in table order, without gathering the table in one task."""
    return runs.numbered(table(spark, sf_dir, "testing_data").select("item_no"), ["item_no"])


@query("SELECT item_no, task_index FROM (SELECT item_no, row_number() OVER (ORDER BY item_no) - 1 AS task_index FROM testing_data) WHERE task_index >= 100 AND task_index < 150")
def task_shard(spark, sf_dir):
    """A shard of tasks by start and count, as a run is given one."""
    return runs.shard(runs.numbered(table(spark, sf_dir, "testing_data").select("item_no"), ["item_no"]), 100, 50)


@query(r"""SELECT run_id, arg_max(file_path, n * 10000000000 + rn) AS latest FROM (SELECT run_id, file_path, n, row_number() OVER (ORDER BY file_path) AS rn FROM
(SELECT run_id, file_path, nullif(regexp_extract(file_path, '(\d+)(?:\.\w+)*$', 1), '')::DECIMAL(27,0) AS n FROM raw_file) WHERE n IS NOT NULL) GROUP BY 1""")
def latest_files(spark, sf_dir):
    """The file with the highest number at the end of its name, for each run."""
    return runs.latest_by_suffix(table(spark, sf_dir, "raw_file").select("run_id", "file_path"), "run_id", "file_path")


@query(r"""WITH k AS (SELECT DISTINCT file_path, unnest(list_distinct(list_filter([regexp_replace(regexp_extract(file_path, '[^/]*$'), '\.[^.]*$', ''),
CASE WHEN json_valid(content) AND json_type(content) = 'OBJECT' THEN nullif(json_extract_string(content, '$.task_id'), '') END], lambda x: x IS NOT NULL))) AS key FROM raw_file
WHERE NOT starts_with(regexp_extract(file_path, '[^/]*$'), '_')) SELECT key, count(DISTINCT file_path) AS n_files FROM k GROUP BY 1 HAVING count(DISTINCT file_path) > 1""")
def ambiguous_keys(spark, sf_dir):
    """Keys (file stems and stored ids) that several files claim."""
    name = F.element_at(F.split("file_path", "/"), -1)
    body = F.when(jsonx.is_object(F.col("content")), F.col("content"))
    bodies = table(spark, sf_dir, "raw_file").where(~name.startswith("_")).select("file_path", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), body.alias("content"))
    return files.ambiguous(files.index_records(bodies))


@query("SELECT file_path, sha256(content) AS sha256 FROM raw_file WHERE content IS NOT NULL")
def file_digests(spark, sf_dir):
    return files.digests(table(spark, sf_dir, "raw_file").where("content IS NOT NULL"))


# --- arrays ----------------------------------------------------------------------

TOKENS_SQL = "string_split(trim(regexp_replace({0}, '\\s+', ' ', 'g'), ' '), ' ')".replace("\\\\", "\\")


def _tokens(column: str):
    return F.split(F.trim(F.regexp_replace(column, r"[ \t\n\r\f]+", " ")), " ")


@query(f"""WITH t AS (SELECT record_id, {TOKENS_SQL.format('raw_response')} AS a, {TOKENS_SQL.format('code')} AS b FROM code_record WHERE raw_response IS NOT NULL AND code IS NOT NULL)
SELECT record_id, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b)))::BIGINT AS n_shared FROM t""")
def shared_prefixes(spark, sf_dir):
    """Words that response and code share from their start."""
    rows = table(spark, sf_dir, "code_record").where("raw_response IS NOT NULL AND code IS NOT NULL")
    return rows.select("record_id", arrays.common_prefix(_tokens("raw_response"), _tokens("code")).alias("n_shared"))


@query(f"""WITH t AS (SELECT item_no, list_transform({TOKENS_SQL.format('question')}, lambda w: length(w)) AS ids FROM testing_data WHERE question IS NOT NULL)
SELECT item_no, array_to_string(list_concat(list_transform(range(least(5, len(ids))), lambda i: -100), ids[6:]), ' ') AS labels FROM t""")
def label_masks(spark, sf_dir):
    """Labels with the first five ids ignored (ids are word lengths here)."""
    rows = table(spark, sf_dir, "testing_data").where("question IS NOT NULL")
    ids = F.transform(_tokens("question"), lambda w: F.length(w))
    return rows.select("item_no", F.array_join(arrays.mask_prefix(ids, F.lit(5)), " ").alias("labels"))


@query(f"""WITH t AS (SELECT item_no, item_no // 8 AS batch, list_transform({TOKENS_SQL.format('question')}, lambda w: length(w)) AS ids FROM testing_data WHERE question IS NOT NULL),
m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS n FROM t)
SELECT item_no, batch, md5(array_to_string(list_concat(ids, list_transform(range(n - len(ids)), lambda i: 0)), ' ')) AS padded FROM m""")
def padded_batches(spark, sf_dir):
    """Every row padded to the longest of its batch of eight."""
    rows = table(spark, sf_dir, "testing_data").where("question IS NOT NULL").select("item_no", F.expr("item_no div 8").alias("batch"), F.transform(_tokens("question"), lambda w: F.length(w)).alias("ids"))
    longest = F.max(F.size("ids")).over(W.partitionBy("batch"))
    return rows.withColumn("n", longest).select("item_no", "batch", F.md5(F.array_join(arrays.pad(F.col("ids"), F.col("n"), 0), " ")).alias("padded"))


ENCODE_SQL = f"""CASE WHEN task_id IS NULL THEN 'missing_id' WHEN original_prompt IS NULL OR NOT regexp_matches(original_prompt, '\\S') THEN 'empty_prompt'
WHEN contract IS NULL THEN 'empty_target' WHEN len({TOKENS_SQL.format('original_prompt')}) > 120 THEN 'exceeds_max_length' END""".replace("\\\\", "\\")


@query(f"SELECT coalesce({ENCODE_SQL}, 'kept') AS reason, split, count(*) AS n FROM training_data GROUP BY 1, 2")
def encode_rejections(spark, sf_dir):
    """Training rows that cannot be encoded, by first reason; lengths are words here."""
    reason = (
        F.when(F.col("task_id").isNull(), "missing_id").when(text.is_blank(F.col("original_prompt")), "empty_prompt")
        .when(F.col("contract").isNull(), "empty_target").when(F.size(_tokens("original_prompt")) > 120, "exceeds_max_length")
    )
    return _training(spark, sf_dir).groupBy(F.coalesce(reason, F.lit("kept")).alias("reason"), "split").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT split, item_no, {ENCODE_SQL} AS reason FROM training_data WHERE ({ENCODE_SQL}) IS NOT NULL AND split = 'train' UNION ALL SELECT 'val', item_no, {ENCODE_SQL} FROM training_data WHERE ({ENCODE_SQL}) IS NOT NULL AND split = 'val'")
def removed_records(spark, sf_dir):
    """Removed rows of both splits in one table, tagged by split."""
    reason = (
        F.when(F.col("task_id").isNull(), "missing_id").when(text.is_blank(F.col("original_prompt")), "empty_prompt")
        .when(F.col("contract").isNull(), "empty_target").when(F.size(_tokens("original_prompt")) > 120, "exceeds_max_length")
    )
    rows = _training(spark, sf_dir).select("split", "item_no", reason.alias("reason")).where("reason IS NOT NULL")
    return rows.where("split = 'train'").unionByName(rows.where("split = 'val'"))


# --- more on contracts, chat examples and nested values ------------------------------

FAULT_SQL = f"""CASE WHEN contract IS NULL OR trim(contract) = '' THEN 'missing' WHEN NOT {VALID_SQL} THEN 'invalid_json'
WHEN len(list_filter({KEYS_SQL}, lambda k: NOT list_contains(json_keys(contract), k))) > 0 THEN 'missing_keys'
WHEN len(list_filter(json_keys(contract), lambda k: NOT list_contains({KEYS_SQL}, k))) > 0 THEN 'extra_keys'
WHEN json_type(contract, '$.interface') <> 'OBJECT' OR json_type(contract, '$.preconditions') <> 'ARRAY' OR json_type(contract, '$.postconditions') <> 'ARRAY' OR json_type(contract, '$.invariants') <> 'ARRAY' THEN 'wrong_types' END"""


@query(f"SELECT record_id, {FAULT_SQL} AS fault FROM contract_record")
def contract_faults(spark, sf_dir):
    return table(spark, sf_dir, "contract_record").select("record_id", jsonx.contract_fault(F.col("contract")).alias("fault"))


@query(f"""SELECT source, count(*) AS n FROM (SELECT CASE WHEN trim(contract) = 'null' THEN 'none' WHEN {VALID_SQL} AND len(list_filter({KEYS_SQL}, lambda k: NOT list_contains(json_keys(contract), k))) = 0 THEN 'parsed'
WHEN regexp_matches(raw_response, '\\S') THEN 'raw' ELSE 'none' END AS source FROM contract_record) GROUP BY 1""".replace("\\\\", "\\"))
def contract_sources(spark, sf_dir):
    source = jsonx.contract_source(F.col("contract"), F.col("raw_response"))
    return table(spark, sf_dir, "contract_record").groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n"))


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.when(F.col("contract").isNotNull(), F.to_json("contract", {"ignoreNullFields": "false"}))
    messages = selection.chat_example(F.lit("Write the contract of the task as JSON."), text.normalize_prompt(F.col("original_prompt")), target)
    return _training(spark, sf_dir).select("item_no", "split", messages.alias("messages"))


@query("""SELECT item_no, CASE WHEN NOT regexp_matches(coalesce(original_prompt, ''), '\\S') THEN 'empty_prompt' WHEN contract IS NULL THEN 'empty_target' END AS fault FROM training_data""".replace("\\\\", "\\"))
def chat_faults(spark, sf_dir):
    return _examples(spark, sf_dir).select("item_no", selection.chat_fault(F.col("messages")).alias("fault"))


@query("""SELECT split, count(*) AS total, count(*) FILTER (regexp_matches(coalesce(original_prompt, ''), '\\S') AND contract IS NOT NULL) AS retained,
count(*) FILTER (NOT regexp_matches(coalesce(original_prompt, ''), '\\S') OR contract IS NULL) AS removed FROM training_data GROUP BY 1""".replace("\\\\", "\\"))
def retained_totals(spark, sf_dir):
    rows = _examples(spark, sf_dir).select("split", selection.chat_fault(F.col("messages")).alias("fault"))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("fault").isNull()).alias("retained"), F.count("fault").alias("removed"))


@query("""SELECT item_no, array_to_string(list_transform(contract.postconditions, lambda c, i: CASE WHEN i = 1 THEN 'Q0' ELSE c.id END), ',') AS ids FROM training_data WHERE contract.postconditions IS NOT NULL""")
def patched_clauses(spark, sf_dir):
    """The first postcondition replaced by another value."""
    ids = F.transform("contract.postconditions", lambda c: c["id"])
    rows = _training(spark, sf_dir).where("contract.postconditions IS NOT NULL")
    return rows.select("item_no", F.array_join(arrays.replace_at(ids, F.lit(0), F.lit("Q0")), ",").alias("ids"))


@query("""SELECT item_no, contract.interface.mode AS mode, contract.interface.function_name AS function_name, contract.interface.signature AS signature FROM training_data WHERE contract IS NOT NULL""")
def trimmed_interfaces(spark, sf_dir):
    """Interfaces without their channels and class."""
    face = F.col("contract.interface").dropFields("input_channel", "output_channel", "class_name")
    return _training(spark, sf_dir).where("contract IS NOT NULL").select("item_no", face.alias("f")).select("item_no", "f.*")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def event_properties(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "string").alias("k"))


@query("""SELECT vec_id, len(embedding) AS n, len(list_filter(embedding, lambda x: x > 0)) AS n_positive FROM embeddings""")
def flattened_vectors(spark, sf_dir):
    """Nested lists of one element unwrapped."""
    ids = arrays.unwrap_ids(F.array("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(ids).cast("long").alias("n"), F.size(F.filter(ids, lambda x: x > 0)).cast("long").alias("n_positive"))
