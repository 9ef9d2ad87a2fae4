"""From outcomes of single tests to results of tasks and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sparloom.functions.jsonx import is_object

#: Failures of tests, the one that explains a task best first.
FAILURE_ORDER = [
    "syntax_error", "compile_error", "compile_or_load_error", "runtime_or_process_error", "timeout", "logical_error", "incomplete_results", "unknown_result",
]
#: Failures of a task whose tests were never run.
UNRUN = ["invalid_test_data", "no_tests", "missing_code", "invalid_code_file", "syntax_error", "evaluator_error"]


def failure_rank(failure: Column) -> Column:
    ranks = F.create_map(*[x for i, name in enumerate(FAILURE_ORDER) for x in (F.lit(name), F.lit(i))])
    return F.coalesce(ranks[failure], F.lit(len(FAILURE_ORDER)))


def outcome_name(code: Column) -> Column:
    """Name of a raw result: true, false or a code as text."""
    return (
        F.when(code.isin("true", "1"), "passed").when(code.isin("false", "0"), "logical_error").when(code == "-1", "timeout")
        .when(code == "-2", "compile_or_load_error").when(code == "-3", "runtime_or_process_error").when(code == "-4", "compile_error")
        .otherwise("unknown_result")
    )


def failed_result(task: Column, total: Column, kind: Column) -> Column:
    """The result of a task whose tests were never run, for one of ``UNRUN``."""
    kind = F.when(kind.isin(UNRUN), kind).otherwise("evaluator_error")
    return F.struct(
        task.alias("task"), F.lit(False).alias("passed"), F.lit(0).cast("long").alias("tests_run"), total.cast("long").alias("tests_total"),
        F.lit(0).cast("long").alias("tests_passed"), F.lit(0.0).alias("pass_percentage"), kind.alias("failure_type"),
        F.array(kind).alias("failure_reasons"), F.create_map(kind, F.lit(1)).alias("outcome_counts"),
    )


def unrun_kind(tests: Column, code: Column) -> Column:
    """Why a task cannot be run, null if it can: its tests (JSON) are unreadable or none, its code is missing."""
    sizes = [F.json_array_length(F.get_json_object(tests, f"$.{k}")) for k in ("inputs", "outputs")]
    n = F.when(is_object(tests) & sizes[0].isNotNull() & sizes[1].isNotNull(), F.least(*sizes)).otherwise(-1)
    return F.when(n < 0, "invalid_test_data").when(n == 0, "no_tests").when(code.isNull() | (F.trim(code) == ""), "missing_code")


def ordered_reasons(outcomes: Column, total: Column) -> Column:
    """Distinct failures of a task, the one that explains it best first; incomplete_results if tests are missing."""
    short = F.when(F.size(outcomes) != total, F.array(F.lit("incomplete_results"))).otherwise(F.array().cast("array<string>"))
    held = F.concat(outcomes, short)
    return F.filter(F.array(*map(F.lit, FAILURE_ORDER)), lambda name: F.array_contains(held, name))


def early_stop(tests: DataFrame, task: str, order: list[str], outcome: str = "outcome") -> DataFrame:
    """Tests of each task up to and including the first that failed."""
    before = W.partitionBy(task).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    failed = F.sum((F.col(outcome) != "passed").cast("int")).over(before)
    return tests.withColumn("failed_before", F.coalesce(failed, F.lit(0))).where("failed_before = 0").drop("failed_before")


def task_results(tests: DataFrame, tasks: DataFrame, task: str, order: list[str]) -> DataFrame:
    """One row for each task: tests run, passed and in total, and the failure that explains it best.

    Tests are exchanged once, by task: what ran before the first failure and
    all counts come from the same window and aggregation.
    """
    before = W.partitionBy(task).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ran = F.coalesce(F.max(F.col("outcome") != "passed").over(before), F.lit(False)) == F.lit(False)
    counted = tests.withColumn("ran", ran).groupBy(task).agg(
        F.count(F.lit(1)).alias("tests_total"), F.count_if("ran").alias("tests_run"),
        F.count_if(F.col("ran") & (F.col("outcome") == "passed")).alias("tests_passed"),
        F.min_by("outcome", F.when(F.col("ran"), failure_rank(F.col("outcome")))).alias("worst"),
    )
    joined = tasks.select(task).join(counted, task, "left")
    zero = F.lit(0).cast("long")
    counts = {c: F.coalesce(F.col(c), zero) for c in ("tests_total", "tests_run", "tests_passed")}
    passed = (counts["tests_total"] > 0) & (counts["tests_passed"] == counts["tests_total"])
    failure = F.when(counts["tests_total"] == 0, "no_tests").when(~passed, F.col("worst"))
    return joined.select(
        task, *[c.alias(n) for n, c in counts.items()], passed.alias("passed"), failure.alias("failure_type"),
        F.bround(F.coalesce(F.try_divide(100 * counts["tests_passed"], counts["tests_total"]), F.lit(0.0)), 4).alias("pass_percentage"),
    )


def run_summary(results: DataFrame) -> DataFrame:
    """One row: pass@1 over all tasks and the pass rate over all tests, run or not."""
    n = F.count(F.lit(1))
    return results.agg(
        n.alias("selected"), F.count_if("passed").alias("passed"),
        F.bround(F.try_divide(F.count_if("passed"), n), 6).alias("pass_at_1"),
        F.count_if(F.col("tests_passed") > 0).alias("tasks_with_a_pass"),
        F.sum("tests_run").alias("tests_run"), F.sum("tests_passed").alias("tests_passed"), F.sum("tests_total").alias("tests_total"),
        F.bround(F.try_divide(F.sum("tests_passed"), F.sum("tests_total")), 6).alias("test_pass_rate"),
    )


def failure_counts(results: DataFrame) -> DataFrame:
    return results.where(F.col("failure_type").isNotNull()).groupBy("failure_type").agg(F.count(F.lit(1)).alias("n"))


def outcome_histogram(tests: DataFrame, task: str) -> DataFrame:
    """Map of outcome to number for each task, keys sorted."""
    per = tests.groupBy(task, "outcome").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(task).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n")))).alias("outcomes"))
