"""Joins and summaries over generation runs: tasks with their results, work
that is still to be done, and counters of runs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from sparloom.functions.arrays import index_p95
from sparloom.functions.text import is_blank


def with_results(tasks: DataFrame, results: DataFrame, key: str, missing: Column, policy: str = "keep") -> DataFrame:
    """Tasks with their results. ``policy``: keep unmatched tasks (with ``missing``
    in column ``status``), drop them, or raise."""
    marked = results.withColumn("_found", F.lit(True))
    joined = tasks.join(marked, key, "inner" if policy == "drop" else "left")
    if policy == "raise":
        from sparloom.operators.selection import require_none

        require_none(joined.where(F.col("_found").isNull()), "tasks without result", key)
    return joined.withColumn("status", F.when(F.col("_found").isNull(), missing).otherwise(F.lit("ok"))).drop("_found")


def remaining(jobs: DataFrame, records: DataFrame, keys: list[str], finished: Column) -> DataFrame:
    """Jobs without a finished record (an anti join on the slim key)."""
    return jobs.join(records.where(finished).select(*keys).distinct(), keys, "left_anti")


def finished_response() -> Column:
    """A response that is not blank and has no issue."""
    return ~is_blank(F.col("raw_response")) & is_blank(F.col("generation_issue"))


def finished_code() -> Column:
    return ~is_blank(F.col("code")) & is_blank(F.col("generation_issue"))


def counters(records: DataFrame, by: list[str], flags: dict[str, Column], seconds: str | None = None) -> DataFrame:
    """Rows, rows with each flag, and rounded seconds for each group. NaN counts as no value."""
    sums = [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in flags.items()]
    if seconds:
        value = F.nanvl(F.col(seconds), F.lit(None).cast("double"))
        sums.append(F.bround(F.sum(F.coalesce(value, F.lit(0.0)).cast("decimal(20,6)")).cast("double"), 3).alias("seconds"))
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("saved"), *sums)


def length_summary(df: DataFrame, by: str, length: str) -> DataFrame:
    """count, min, median (cut to an integer), 95th percentile by index, and max."""
    return df.where(F.col(length).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.min(length).alias("shortest"),
        F.percentile(length, 0.5).cast("long").alias("median"),
        index_p95(F.collect_list(length)).alias("p95"), F.max(length).alias("longest"),
    )


def length_summary_exact(df: DataFrame, by: str, length: str) -> DataFrame:
    """The same without gathering a group: lengths are counted first, ranks come
    from running sums over the distinct lengths, which are few."""
    per = df.where(F.col(length).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(length).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy("_by").orderBy("_v")
    ranked = per.withColumn("_upto", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(W.partitionBy("_by")))
    p95_rank = F.greatest(F.lit(1), F.least(F.col("_n"), F.floor(F.col("_n") * 0.95)))
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    at = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col("_v")))
    return ranked.groupBy(F.col("_by").alias(by)).agg(
        F.max("_n").alias("n"), F.min("_v").alias("shortest"),
        ((at(low) + at(high)) / 2).cast("long").alias("median"), at(p95_rank).alias("p95"), F.max("_v").alias("longest"),
    )


def numbered(df: DataFrame, order: list[str], name: str = "task_index") -> DataFrame:
    """Contiguous row numbers over the whole table in a given order.

    A window without partitions would run in one task; here each range
    partition numbers its own rows and adds the rows before it.
    """
    from sparloom.storage import staged

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    kept = staged(ranged, "numbered")
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    w = W.partitionBy("_part").orderBy(*order)
    return (
        kept.join(F.broadcast(offsets.select("_part", "_before")), "_part")
        .withColumn(name, F.row_number().over(w) + F.col("_before") - 1).drop("_part", "_before")
    )


def shard(df: DataFrame, start: int, count: int | None, index: str = "task_index") -> DataFrame:
    """Rows with start <= index < start + count; no count means all."""
    out = df.where(F.col(index) >= start)
    return out if count is None else out.where(F.col(index) < start + count)


def latest_by_suffix(df: DataFrame, by: str, path: str) -> DataFrame:
    """The path with the largest number at its end (before any extension), for each group."""
    number = F.nullif(F.regexp_extract(path, r"(\d+)(?:\.\w+)*$", 1), F.lit("")).cast("decimal(38,0)")
    return df.withColumn("_n", number).where(F.col("_n").isNotNull()).groupBy(by).agg(F.max_by(path, F.struct("_n", path)).alias("latest"))


def tries(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows with ``attempt``, their number among those of the same key."""
    return df.withColumn("attempt", F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def context_budget(prompt: Column, output: Column, context: Column) -> tuple[Column, Column]:
    """(outcome, output tokens allowed): fits, clamped to what is left, exceeds, or unknown."""
    left = context - prompt
    outcome = F.when(prompt.isNull(), "unknown").when(output <= left, "fits").when(left > 0, "clamped").otherwise("exceeds")
    return outcome, F.when(left > 0, F.least(output, left))


def require_budget(df: DataFrame, outcome: str, key: str) -> None:
    """Raise if a prompt with its output exceeds the context (the policy that does not clamp)."""
    from sparloom.operators.selection import require_none

    require_none(df.where(F.col(outcome).isin("clamped", "exceeds")), "context exceeded", key)


def first_text(*columns: str | Column) -> Column:
    """The first value that is not blank, stripped."""
    from sparloom.functions.text import strip

    return F.coalesce(*[F.nullif(strip(F.col(c) if isinstance(c, str) else c), F.lit("")) for c in columns])


def index_conflicts(records: DataFrame, jobs: DataFrame, key: str, index: str, expected: str = "expected") -> DataFrame:
    """Records whose index is set and not that of their job; a resumed run raises on them."""
    return records.where(F.col(index).isNotNull()).join(jobs, key).where(F.col(index) != F.col(expected))


def version_matches(expected: dict[str, Column]) -> Column:
    """Whether a record carries these values, null matching nothing."""
    same = F.lit(True)
    for name, value in expected.items():
        same = same & F.coalesce(F.col(name) == value, F.lit(False))
    return same


def fingerprint(*columns: str) -> Column:
    """SHA-256 of settings; null counts as the empty text."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("binary"), 256)


def stamped(df: DataFrame, name: str = "generated_at") -> DataFrame:
    """Rows with the time of the query."""
    return df.withColumn(name, F.current_timestamp())


def provenance(spark: SparkSession, settings: dict[str, str], bodies: DataFrame | None = None) -> DataFrame:
    """One row: settings as JSON, their digest, the digest of all input bodies, and the time.

    Bodies (file_path, sha256) are hashed one by one and combined by an order-free sum."""
    digest = F.sum(F.xxhash64("file_path", "sha256").cast("decimal(38,0)")).alias("files_digest")
    row = spark.range(1).select() if bodies is None else bodies.agg(F.count(F.lit(1)).alias("n_files"), digest)
    shown = F.lit(json.dumps(settings, sort_keys=True))
    return stamped(row.withColumn("settings", shown).withColumn("settings_sha256", F.sha2(F.col("settings").cast("binary"), 256)))


def accounting(df: DataFrame, column: str, parts: dict[str, str]) -> DataFrame:
    """One row: all rows, rows of each part, and whether the parts add up to all."""
    counted = df.agg(F.count(F.lit(1)).alias("selected"), *[F.count_if(F.col(column) == value).alias(name) for value, name in parts.items()])
    return counted.withColumn("balanced", F.col("selected") == sum((F.col(name) for name in parts.values()), F.lit(0)))


def require_balanced(accounted: DataFrame) -> None:
    """Raise unless the parts add up."""
    row = accounted.first()
    if not row["balanced"]:
        raise ValueError(f"rows do not add up: {row.asDict()}")
