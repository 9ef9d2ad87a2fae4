import json

from pyspark.sql import functions as F

from sparloom.operators import small_files as S

SCHEMA = "run_id string, file_path string, content string, note string"


def keys(df):
    return sorted((r["run_id"], r["task_id"]) for r in df.collect())


def test_records_of_every_kind_of_body(spark):
    rows = [
        ("r", "o/r/a.json", '{"task_id": "a", "x": 1}', ""),
        ("r", "o/r/copy_a.json", '{\n "x": 1,\n "task_id": "a"}', ""),
        ("r", "o/r/batch.json", '[{"task_id": "b"}, {"task_id": "c"}, 3]', ""),
        ("r", "o/r/batch.jsonl", '{"task_id": "d"}\n\nnot json\n{"task_id": "e"}\n{"task_id": "f', ""),
        ("r", "o/r/half.json.part", '{\n "task_id": "h",\n "x"', ""),
        ("r", "o/r/_summary.json", '{"task_id": "s"}', ""),
        ("r", "o/r/name.1.json", '{"task_id": null}', ""),
        ("r", "o/r/other.json", '{"task_id": "None"}', ""),
        ("r", "o/r/third.json", '{"y": "\\ud800"}', ""),
        (None, None, '{"task_id": ""}', ""),
        ("r", "o/r/e.json", "", None), ("r", "o/r/n.json", None, None), ("r", "o/r/l.json", "[]", None),
        ("r", "o/r/bom.json", '﻿{"task_id": "m"}', None), ("r", "o/r/num.json", '{"task_id": 7}', None),
    ]
    store = S.consolidate(spark.createDataFrame(rows, SCHEMA), "test")
    assert [k[1] for k in keys(store.where("run_id is not null"))] == ["7", "a", "b", "c", "d", "e", "m", "name", "other", "third"]
    assert store.where("run_id is null").collect()[0]["task_id"] == ""
    assert all(json.loads(r["record"]) for r in store.collect() if r["task_id"] != "")


def test_empty_table_and_hot_key(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.consolidate(empty, "test").count() == 0
    hot = spark.range(3000).select(
        F.lit("r").alias("run_id"), F.concat(F.lit("o/r/"), F.col("id").cast("string"), F.lit(".json")).alias("file_path"),
        F.when(F.col("id") % 3 == 0, F.lit('{"task_id": "hot"}')).otherwise(F.lit("{}")).alias("content"),
    )
    store = S.consolidate(hot, "test", target_file_bytes=1000)
    assert store.count() == 2001
    assert len(store.inputFiles()) <= -(-3000 * 18 // 1000)


def test_loss_is_noticed(spark, monkeypatch):
    rows = [("r", f"o/r/{i}.json", "{}", "") for i in range(5)]
    monkeypatch.setattr(S, "one_copy", lambda records, places: records.where("task_id <> '3'").select("run_id", "task_id", "record"))
    try:
        S.consolidate(spark.createDataFrame(rows, SCHEMA), "test")
    except RuntimeError as error:
        assert "differs" in str(error)
    else:
        raise AssertionError


def test_folder_of_files(spark, tmp_path):
    for i in range(40):
        folder = tmp_path / f"run{i % 2}"
        folder.mkdir(exist_ok=True)
        (folder / f"t{i}.json").write_text(json.dumps({"task_id": f"t{i}"}, indent=1))
    bodies = S.read_bodies(spark, str(tmp_path))
    assert bodies.rdd.getNumPartitions() < 10
    assert S.consolidate(bodies, "test").groupBy("run_id").count().count() == 2


def test_streamed_files_are_taken_once(spark, tmp_path):
    from sparloom.streaming import consolidate_new

    source = tmp_path / "in" / "run"
    source.mkdir(parents=True)
    args = (str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    (source / "a.json").write_text('{"task_id": "a"}')
    consolidate_new(spark, *args)
    (source / "b.json").write_text('[{"task_id": "b"}, {"task_id": "a"}]')
    consolidate_new(spark, *args)
    consolidate_new(spark, *args)
    assert sorted(r["task_id"] for r in spark.read.parquet(args[1]).collect()) == ["a", "b"]
