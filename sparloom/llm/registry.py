"""Queries of the text operators (problems 2 and 4 to 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparloom.llm import chat, cross_split, encode, langid, packing, pairs, pii, syntax, truncation
from sparloom.operators import selection
from sparloom.storage import staged, table


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = [table(spark, sf_dir, name).select("task_id", "question") for name in ("testing_data", "probe_task")]
    return asked[0].unionByName(asked[1])


def _defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "code_record").select("record_id", "task_id", "raw_response", "code")
    answers = records.select("record_id", F.coalesce("raw_response", "code").alias("answer"))
    ends = truncation.learn(staged(truncation.features(answers, "", "record_id", "answer"), "ends"))
    languages = langid.fit_from(table(spark, sf_dir, "documents"))
    return pairs.defects(records, _questions(spark, sf_dir), ends, languages, staged)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with their defect."""
    return _defects(spark, sf_dir)


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by model and defect."""
    models = table(spark, sf_dir, "code_record").select("record_id", "model")
    return (
        models.join(_defects(spark, sf_dir), "record_id", "left")
        .groupBy("model", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count(F.lit(1)).alias("n"))
    )


def _truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.scored_tables({
        name: table(spark, sf_dir, name).select("record_id", "model", "raw_response") for name in ("code_record", "contract_record")
    }, staged)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses that break off."""
    return _truncated(spark, sf_dir).where("cut_").select("tab", F.col("key_").alias("record_id"))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of responses that break off, by table and model."""
    return truncation.rates(_truncated(spark, sf_dir))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.check_files(table(spark, sf_dir, "code_file"), "file_id", "file_path", "code", "run_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are not valid in their language."""
    return _checked(spark, sf_dir).where(~F.col("valid_")).select(F.col("key_").alias("file_id"))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalid files per run and language."""
    return syntax.rates(_checked(spark, sf_dir))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = table(spark, sf_dir, "training_data").select(
        "item_no", F.lower(F.trim("split")).alias("split"), "source", cross_split.id_key(F.col("task_id")).alias("task_key"),
        cross_split.hash_key(F.col("prompt_hash")).alias("hash_key"), F.col("original_prompt").alias("statement"),
    ).where("split in ('train', 'val')")
    held_out = [
        table(spark, sf_dir, name).select(
            "item_no", "split", "source", cross_split.id_key(F.col("task_id")).alias("task_key"),
            F.lit(None).cast("string").alias("hash_key"), F.col("question").alias("statement"),
        )
        for name in ("testing_data", "probe_task")
    ]
    return (
        train.withColumn("side", F.when(F.col("split") == "train", "train").otherwise("eval"))
        .unionByName(held_out[0].unionByName(held_out[1]).withColumn("side", F.lit("eval")))
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a training row and an evaluation row that are the same task."""
    pairs_ = cross_split.overlaps(_tasks(spark, sf_dir), staged)
    return pairs_.select(F.least("item_train", "item_eval").alias("item_a"), F.greatest("item_train", "item_eval").alias("item_b"))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs for each evaluation split and source."""
    records = _tasks(spark, sf_dir)
    return cross_split.counts(cross_split.overlaps(records, staged), records)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode.encode_documents(table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or part of a long one, with its container."""
    return packing.pack(staged(packing.measured(table(spark, sf_dir, "documents")), "measured"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use of the space of all containers."""
    return packing.fill_report(p8_containers(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every e-mail address, phone and identity number, street address and name."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(documents, staged)


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.redact(documents, p9_found(spark, sf_dir))


def chat_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows as chat examples of at most 1,024 ids: reason, lengths, and a digest of the labels."""
    target = F.when(F.col("contract").isNotNull(), F.to_json("contract", {"ignoreNullFields": "false"}))
    messages = selection.chat_example(F.lit("Write the contract of the task as JSON."), F.col("original_prompt"), target)
    rows = chat.encoded(table(spark, sf_dir, "training_data").select("item_no", messages.alias("messages")), "messages", 1024)
    return rows.select(
        "item_no", "reason", F.size("input_ids").alias("n_ids"), F.size(F.filter("labels", lambda x: x == -100)).alias("n_ignored"), F.xxhash64("labels").alias("labels_hash")
    )


QUERIES = {
    "chat_encoding": chat_encoding,
    "p2_found": p2_found, "p2_rates": p2_rates, "p4_found": p4_found, "p4_rates": p4_rates,
    "p5_found": p5_found, "p5_rates": p5_rates, "p6_found": p6_found, "p6_counts": p6_counts, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_fill": p8_fill,
    "p9_found": p9_found, "p9_redacted": p9_redacted,
}
ORACLE: dict[str, str] = {}
