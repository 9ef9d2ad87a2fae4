"""Row selection with reasons, stratified splits, duplicates and leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sparloom.functions.arrays import common_prefix, mask_prefix, ratio, validation_count
from sparloom.functions.text import DIFFICULTIES, is_blank, normalize_difficulty
from sparloom.operators.runs import numbered
from sparloom.storage import staged


def absent(task_id: Column) -> Column:
    """Null, blank or the word None."""
    return is_blank(task_id) | (task_id == "None")


def rejection(min_tests: int = 51, min_ratio: float = 0.75, all_cleaned: bool = False) -> Column:
    """The first reason to leave out a cleaned row, null to keep it."""
    reason = F.when(absent(F.col("task_id")), "missing_task_id").when(
        F.coalesce(~normalize_difficulty(F.col("difficulty")).isin(DIFFICULTIES), F.lit(True)), "invalid_difficulty"
    )
    if not all_cleaned:
        reason = reason.when(F.coalesce("number_of_test_cases", F.lit(0)) < min_tests, "insufficient_tests").when(
            ratio(F.col("test_cases_passed"), F.col("number_of_test_cases")) < min_ratio, "low_pass_ratio"
        )
    return reason


def duplicates(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key occurred in an earlier row, with the number of that occurrence.

    Ranking runs over keys, so one frequent key is one window group of slim
    rows; only key and order column take part.
    """
    w = W.partitionBy(key).orderBy(order)
    return df.where(F.col(key).isNotNull()).select(key, order).withColumn("occurrence", F.row_number().over(w)).where("occurrence > 1")


def _mixed(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def stratified_split(df: DataFrame, stratum: str, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """``df`` with ``assigned`` (train or val): of each stratum the first rows in
    order of a seeded hash go to validation.

    A stratum may hold most rows, so it is no window of its own: rows are
    range-partitioned by stratum and hash, ranked within their part, and moved
    on by the number of rows of their stratum in the parts before.
    """
    order = [stratum, "_hash", key]
    ranged = df.withColumn("_hash", _mixed(seed, key)).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    kept = staged(ranged, "strata")
    sizes = kept.groupBy("_part", F.col(stratum).alias("_stratum")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("_stratum").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("_part").alias("_in"), "_stratum", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy("_stratum")).alias("_total")
    )
    rank = F.row_number().over(W.partitionBy("_part", stratum).orderBy("_hash", key)) + F.col("_before")
    joined = kept.join(offsets, (F.col("_part") == F.col("_in")) & F.col(stratum).eqNullSafe(F.col("_stratum")))
    assigned = F.when(rank <= validation_count(F.col("_total"), share), "val").otherwise("train")
    return joined.withColumn("assigned", assigned).select(*df.columns, "assigned")


def shuffled(df: DataFrame, key: str, seed: int = 42, name: str = "position") -> DataFrame:
    """Rows with their position in a seeded order of the whole table."""
    return numbered(df.withColumn("_hash", _mixed(seed, key)), ["_hash", key], name).drop("_hash")


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys that occur on both sides (leakage)."""
    return a.select(key).where(F.col(key).isNotNull()).intersect(b.select(key).where(F.col(key).isNotNull()))


def require_none(df: DataFrame, message: str, key: str, show: int = 20) -> None:
    """Raise if ``df`` has rows, naming the first keys."""
    bad = [r[0] for r in df.select(key).distinct().orderBy(key).limit(show).collect()]
    if bad:
        raise ValueError(f"{message}: {', '.join(map(str, bad))}")


def chat_example(system: Column, user: Column, assistant: Column) -> Column:
    """Messages of one training example, in the order system, user, assistant."""
    return F.array(*[F.struct(F.lit(role).alias("role"), c.alias("content")) for role, c in (("system", system), ("user", user), ("assistant", assistant))])


#: Why an example cannot be encoded, in the order of the checks.
ENCODE_REASONS = [
    "invalid_messages", "invalid_message_object", "invalid_role_order", "non_string_message_content", "empty_assistant_content", "invalid_prompt_template_output",
    "invalid_full_template_output", "tokenization_error", "empty_full_sequence", "prompt_prefix_mismatch", "empty_assistant_target", "exceeds_max_length", "empty_training_labels",
]


def encode_reason(messages: Column, prompt: Column, full: Column, prompt_ids: Column, full_ids: Column, max_length: int, ignored: int = -100) -> Column:
    """The first reason not to train on an example, null without one.

    ``prompt`` and ``full`` are the texts of a chat template, the ids their tokens
    (null where the tokenizer failed). What the ids share from their start is the
    prompt, the rest is the target.
    """
    prefix = common_prefix(prompt_ids, full_ids)
    target = F.size(full_ids) - prefix
    labels = mask_prefix(full_ids, prefix)
    failed = [
        messages.isNull() | (F.size(messages) != 3), F.exists(messages, lambda m: m.isNull()),
        F.transform(messages, lambda m: F.coalesce(m["role"], F.lit(""))) != F.array(F.lit("system"), F.lit("user"), F.lit("assistant")),
        F.exists(messages, lambda m: m["content"].isNull()), is_blank(F.element_at(messages, 3)["content"]), prompt.isNull(), full.isNull(),
        prompt_ids.isNull() | full_ids.isNull(), F.size(full_ids) == 0, prefix == 0, target <= 0, F.size(full_ids) > max_length, F.forall(labels, lambda x: x == ignored),
    ]
    reason = F.when(F.coalesce(failed[0], F.lit(False)), ENCODE_REASONS[0])
    for condition, name in zip(failed[1:], ENCODE_REASONS[1:]):
        reason = reason.when(F.coalesce(condition, F.lit(False)), name)
    return reason


def without_rejected(df: DataFrame, reason: str, key: str, fatal: tuple[str, ...] = ()) -> DataFrame:
    """Rows without a reason; raises if any row has a fatal one (policy ``exceeds_max_length`` fatal, or dropped)."""
    if fatal:
        require_none(df.where(F.col(reason).isin(*fatal)), "fatal " + ", ".join(fatal), key)
    return df.where(F.col(reason).isNull())


def require_examples(df: DataFrame, messages: str, key: str, expected: int) -> None:
    """Raise unless there are as many examples as expected, each under an id of its own and without a fault."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("ids"), F.count(chat_fault(F.col(messages))).alias("faults")).first()
    if (row["n"], row["ids"], row["faults"]) != (expected, expected, 0):
        raise ValueError(f"{row['n']} examples with {row['ids']} ids and {row['faults']} faults, {expected} expected")


def chat_fault(messages: Column) -> Column:
    """Why messages are no example: message_count, role_order, empty_prompt or empty_target; null if they are one."""
    roles = F.transform(messages, lambda m: m["role"])
    return (
        F.when(messages.isNull() | (F.size(messages) != 3), "message_count")
        .when(roles != F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), "role_order")
        .when(is_blank(messages[1]["content"]), "empty_prompt").when(is_blank(messages[2]["content"]), "empty_target")
    )
