"""Incremental runs.

Nothing here needs unbounded input. What arrives later is taken in by resumable
batches (:func:`sparloom.operators.runs.remaining`) or, for folders that grow, by
:func:`consolidate_new`, which lets Structured Streaming remember the files it
has seen and hands each batch of new ones to the consolidation operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparloom.operators.small_files import extract_records, one_copy


def consolidate_new(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 100_000) -> None:
    """Append the records of files not seen before to ``target`` and stop.

    A batch writes to a folder of its own, named by its number, and replaces
    it when repeated, so a failed batch leaves no records twice. Records whose
    key is stored already are left out.
    """
    bodies = (
        spark.readStream.format("text").schema("value string").option("wholetext", "true").option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", str(files_per_batch)).load(source)
        .select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run_id"), F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("content"))
    )

    def put(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        new = one_copy(extract_records(batch))
        try:
            stored = session.read.parquet(target).where(F.col("batch") != number).select("run_id", "task_id")
            new = new.join(stored, ["run_id", "task_id"], "left_anti")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
        new.write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = bodies.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
