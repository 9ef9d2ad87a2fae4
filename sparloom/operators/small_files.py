"""Consolidation of many tiny JSON files into few well-sized ones.

The input is a table of file bodies (``run_id``, ``file_path``, ``content``),
or a folder of such files read with :func:`read_bodies`. Steps:

1. *Split packing.* The scan runs in a session of its own whose
   ``maxPartitionBytes`` and ``openCostInBytes`` make the engine put many small
   files into one combined split.
2. *Extraction.* One map-only stage parses the bodies and stages what it finds. A
   record is a JSON object that is a whole body, an element of a whole array, or a line.
3. *One copy each.* Keys with place and hash of their records are exchanged; records
   whose key does not repeat pass without a look, of the others the first copy does.
4. *Staged write.* Partitions are merged with ``coalesce`` (no shuffle) down to
   the number of target files, written to a staging path, verified in number and
   contents, published by a rename.

Defined results: a null or blank body, a half-written body and a file whose
name starts with ``_`` hold no record; a missing, null, ``""`` or ``"None"``
``task_id`` becomes the file name up to its first dot (``""`` for a null path);
a null ``run_id`` is a key value like any other; copies of a key yield the copy
with the smallest (path, position); an empty table yields an empty store.
Columns other than the three named are ignored, whatever they are called.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparloom.storage import filesystem, new_path, staged

RECORD_SCHEMA = "run_id string, task_id string, record string, file_path string, pos int"
ABSENT_IDS = (None, "", "None")


def packed_session(spark: SparkSession, max_partition_bytes: int = 64 << 20, open_cost_bytes: int = 1 << 20) -> SparkSession:
    """A session that packs small files: splits of up to ``max_partition_bytes``,
    each file counted as ``open_cost_bytes`` more than its size. All other settings
    are the caller's."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.files.maxPartitionBytes", str(max_partition_bytes))
    own.conf.set("spark.sql.files.openCostInBytes", str(open_cost_bytes))
    return own


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """``run_id`` (parent folder), ``file_path`` and ``content`` of every file below ``path``."""
    files = packed_session(spark).read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run_id"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("value").alias("content"),
    )


def body_records(content: str | None) -> Iterator[dict]:
    """The JSON objects a file body holds."""
    if not content or not content.strip():
        return
    try:
        whole = json.loads(content.lstrip("\ufeff"))
    except (ValueError, RecursionError):
        for line in content.lstrip("\ufeff").split("\n"):
            if not line.lstrip().startswith("{"):
                continue
            try:
                one = json.loads(line)
            except (ValueError, RecursionError):
                continue
            if isinstance(one, dict):
                yield one
        return
    if isinstance(whole, dict):
        yield whole
    elif isinstance(whole, list):
        yield from (x for x in whole if isinstance(x, dict))


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for run_id, path, content in zip(pdf["run_id"], pdf["file_path"], pdf["content"]):
            name = (path or "").rsplit("/", 1)[-1]
            if name.startswith("_"):
                continue
            for pos, record in enumerate(body_records(content)):
                task = record.get("task_id")
                if task is not None and not isinstance(task, str):
                    task = json.dumps(task, sort_keys=True)
                if task in ABSENT_IDS:
                    task = name.split(".", 1)[0]
                task = task.encode("utf-8", "replace").decode()
                rows.append((run_id, task, json.dumps(record), path, pos))
        yield pd.DataFrame(rows, columns=["run_id", "task_id", "record", "file_path", "pos"])


def extract_records(bodies: DataFrame) -> DataFrame:
    """Every record of every body, copies included (map-only)."""
    return bodies.select("run_id", "file_path", "content").mapInPandas(_extract, RECORD_SCHEMA)


def first_places(records: DataFrame) -> DataFrame:
    """For each key the place and the hash of its first copy, and the number of copies.

    Only keys, places and hashes are exchanged; the records stay where they are."""
    slim = records.select("run_id", "task_id", F.struct("file_path", "pos").alias("place"), F.xxhash64("record").alias("hash"))
    return slim.groupBy("run_id", "task_id").agg(F.min("place").alias("place"), F.min_by("hash", "place").alias("hash"), F.count(F.lit(1)).alias("copies"))


def one_copy(records: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """One record for each (run_id, task_id): only keys that repeat are looked up."""
    repeated = (places if places is not None else first_places(records)).where("copies > 1").select(F.col("run_id").alias("run_"), F.col("task_id").alias("task_"), F.col("place").alias("place_"))
    same = F.col("run_id").eqNullSafe(F.col("run_")) & (F.col("task_id") == F.col("task_"))
    looked = records.join(repeated, same, "left")
    return looked.where(F.col("place_").isNull() | F.struct("file_path", "pos").eqNullSafe(F.col("place_"))).select("run_id", "task_id", "record")


def _contents(keys: DataFrame) -> tuple[int, int]:
    """Number of rows and an order-free sum of hashes of key and record."""
    row = keys.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("run_id", "task_id", "hash").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)


def consolidate(bodies: DataFrame, label: str = "consolidated", target_file_bytes: int = 64 << 20) -> DataFrame:
    """Write the consolidated store of ``bodies`` and return it.

    Bodies are read and parsed once; what was found is staged. The number of
    files is the volume of the records over ``target_file_bytes``. The staged
    store is checked against what was found before it is published: keys and
    records must agree in number and in the sum of their hashes.
    """
    spark = bodies.sparkSession
    records = staged(extract_records(bodies), label + "-found")
    places = staged(first_places(records), label + "-keys")
    volume = records.agg(F.sum(F.length("record").cast("long"))).first()[0] or 0
    n_files = max(1, math.ceil(volume / target_file_bytes))
    path = new_path(spark, label)
    stage = path + "-staging"
    repeated = staged(places.where("copies > 1"), label + "-repeated")  # its size on disk decides how it is joined
    one_copy(records, repeated).coalesce(n_files).write.mode("error").option("compression", "zstd").parquet(stage)
    expected = _contents(places)
    found = _contents(spark.read.parquet(stage).select("run_id", "task_id", F.xxhash64("record").alias("hash")))
    if expected != found:
        raise RuntimeError(f"staged store differs from its source: {expected} expected, {found} found (records, sum of hashes)")
    fs, staged_path = filesystem(spark, stage)
    if not fs.rename(staged_path, filesystem(spark, path)[1]):
        raise RuntimeError(f"cannot publish {stage}")
    return spark.read.parquet(path)


def consolidated_store(spark: SparkSession, sf_dir: str, max_partition_bytes: int = 16 << 20, target_file_bytes: int = 64 << 20) -> DataFrame:
    """The store of the ``raw_file`` table: run_id, task_id, record."""
    own = packed_session(spark, max_partition_bytes)
    return consolidate(own.read.parquet(f"{sf_dir}/raw_file.parquet"), "raw_file", target_file_bytes)
