"""Reading tasks, records and contracts from JSON and JSONL files.

All readers use the packed session, so folders of tiny files become few splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from sparloom.functions.jsonx import is_object
from sparloom.operators.small_files import body_records, extract_records, packed_session

#: Keys under which a task file may keep its list.
LIST_KEYS = ["tasks", "data", "items", "problems", "questions"]


def read_jsonl(spark: SparkSession, path: str, strict: bool = True, allow_empty: bool = True) -> DataFrame:
    """Column ``record`` with one JSON object per non-blank line.

    Strict reading raises on a line that is no object; otherwise such lines are
    left out. ``allow_empty=False`` raises if there is no record.
    """
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S")).select(F.regexp_replace("value", "^\\x{FEFF}", "").alias("record"))
    ok = is_object(F.col("record"))
    if strict:
        lines = lines.withColumn("record", F.when(ok, F.col("record")).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("record", 1, 80)))))
    else:
        lines = lines.where(ok)
    if not allow_empty and lines.isEmpty():
        raise ValueError(f"no records in {path}")
    return lines


def read_bodies(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """file_path, stem and content of whole files below a folder; names with a leading ``_`` are skipped."""
    reader = packed_session(spark).read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    files = reader.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file_path"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        F.regexp_replace("value", "^\\x{FEFF}", "").alias("content"),
    )
    return files.where(~F.col("stem").startswith("_"))


def load_tasks(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Column ``task`` (JSON text): a list, the first list under one of LIST_KEYS,
    a single task, or lines. Entries that are no objects are dropped, or raise."""
    import json

    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = []
            for content in pdf["content"]:
                try:
                    value = json.loads(content) if isinstance(content, str) else None
                except ValueError:
                    value = list(body_records(content))
                if isinstance(value, dict):
                    value = next((value[k] for k in LIST_KEYS if isinstance(value.get(k), list)), [value])
                for entry in value if isinstance(value, list) else []:
                    if isinstance(entry, dict):
                        rows.append(json.dumps(entry))
                    elif strict:
                        raise ValueError(f"a task is no object: {str(entry)[:80]}")
            yield pd.DataFrame({"task": rows}, dtype="object")

    return read_bodies(spark, path).select("content").mapInPandas(run, "task string")


def typed(records: DataFrame, column: str, schema: StructType) -> DataFrame:
    """JSON text parsed with an explicit schema."""
    return records.select(F.from_json(column, schema).alias("r")).select("r.*")


def index_records(bodies: DataFrame) -> DataFrame:
    """key, file_path: each file under its stem and under the id stored in it.

    Keys that several files claim are reported by :func:`ambiguous`.
    """
    stored = F.nullif(F.get_json_object("content", "$.task_id"), F.lit(""))
    keys = F.array_distinct(F.filter(F.array("stem", stored), lambda k: k.isNotNull()))
    return bodies.select("file_path", F.explode(keys).alias("key"))


def ambiguous(index: DataFrame) -> DataFrame:
    return index.groupBy("key").agg(F.count_distinct("file_path").alias("n_files")).where("n_files > 1")


def digests(bodies: DataFrame) -> DataFrame:
    """SHA-256 of each body."""
    return bodies.select("file_path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))


__all__ = ["ambiguous", "digests", "extract_records", "index_records", "load_tasks", "read_bodies", "read_jsonl", "typed"]
