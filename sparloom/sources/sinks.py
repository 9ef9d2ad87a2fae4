"""Writing results. Spark's commit protocol makes every write all or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparloom.functions.text import safe_name
from sparloom.storage import staged


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines with null fields kept; refuses to overwrite unless told so."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", "false").json(path)


def write_keyed(df: DataFrame, path: str, partition_by: list[str] | None = None, overwrite: bool = False) -> None:
    """Records as Parquet keyed by a column, in place of one file for each record."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_kept_and_removed(df: DataFrame, reason: Column, kept: str, removed: str, overwrite: bool = False) -> None:
    """Rows without a reason to one place, the others with their reason to another.

    The input is computed once and staged; both sides read the staged rows.
    """
    marked = staged(df.withColumn("reason", reason), "marked")
    write_keyed(marked.where(F.col("reason").isNull()).drop("reason"), kept, overwrite=overwrite)
    write_keyed(marked.where(F.col("reason").isNotNull()), removed, overwrite=overwrite)


def output_name(task_id: Column, suffix: str = ".json") -> Column:
    return F.concat(safe_name(task_id), F.lit(suffix))


def summary_name(start: int, count: int | None) -> str:
    return f"_summary_{start}_{'all' if count is None else count}.json"


def clashing_outputs(jobs: DataFrame, task_id: str) -> DataFrame:
    """Output names that several different ids share, or that are reserved."""
    named = jobs.select(task_id, output_name(F.col(task_id)).alias("output_name")).distinct()
    return named.groupBy("output_name").agg(F.count(F.lit(1)).alias("n_ids")).where((F.col("n_ids") > 1) | F.col("output_name").startswith("_"))


def write_evaluation(details: DataFrame, summary: DataFrame, path: str, overwrite: bool = False) -> None:
    """Results of tasks as JSON lines below ``details``, their one-row summary below ``summary``."""
    write_jsonl(details, f"{path}/details", overwrite)
    write_jsonl(summary.coalesce(1), f"{path}/summary", overwrite)


def split_errors(df: DataFrame, error: str) -> tuple[DataFrame, DataFrame]:
    """Rows that came out and rows with an error; errors are data with the same columns."""
    return df.where(F.col(error).isNull()), df.where(F.col(error).isNotNull())
