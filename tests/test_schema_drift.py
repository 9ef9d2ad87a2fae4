import datetime as dt
import json

from sparloom.operators import schema_drift as D


def world(spark, runs):
    """runs: list of (run_id, series, {task: record})"""
    store = spark.createDataFrame([(r, t, json.dumps(x)) for r, _, recs in runs for t, x in recs.items()], "run_id string, task_id string, record string")
    table = spark.createDataFrame([(r, s, dt.datetime(2026, 1, 1) + dt.timedelta(days=i)) for i, (r, s, _) in enumerate(runs)], "run_id string, series string, started_at timestamp")
    return store, table


def changes(spark, runs, stage):
    return sorted(tuple(r) for r in D.schema_changes(*world(spark, runs), stage=stage).collect())


def test_every_change(spark, stage):
    one = {f"t{i}": {"task_id": f"t{i}", "path": f"p{i}", "n": i, "old": 1, "w": "x", "rare": None} for i in range(6)}
    one["t0"].pop("rare")
    two = {f"t{i}": {"task_id": f"t{i}", "spec": f"p{i}", "n": str(i), "new": None, "w": "x", "rare": None} for i in range(6)}
    two["t5"]["spec"] = "stray"
    runs = [("a", "s", one), ("b", "s", two), ("z", "other", one), ("c", "s", two)]
    assert changes(spark, runs, stage) == [
        ("b", "added", "new", ""), ("b", "removed", "old", ""), ("b", "renamed", "path", "spec"), ("b", "retyped", "n", "")
    ]


def test_half_of_the_records_and_nulls(spark, stage):
    one = {f"t{i}": {"a": 1} if i < 2 else {} for i in range(4)}
    two = {f"t{i}": {"a": None} if i < 1 else {} for i in range(4)}
    assert changes(spark, [("x", "s", one), ("y", "s", two)], stage) == [("y", "removed", "a", "")]
    null = {f"t{i}": {"a": None} for i in range(4)}
    assert changes(spark, [("x", "s", one), ("y", "s", null)], stage) == []


def test_rename_needs_values_and_type(spark, stage):
    one = {f"t{i}": {"a": i, "b": None} for i in range(4)}
    two = {f"t{i}": {"c": str(i), "d": None} for i in range(4)}
    assert changes(spark, [("x", "s", one), ("y", "s", two)], stage) == [
        ("y", "added", "c", ""), ("y", "added", "d", ""), ("y", "removed", "a", ""), ("y", "removed", "b", "")
    ]
    assert changes(spark, [("x", "s", one)], stage) == []
    store, table = world(spark, [("x", "s", one)])
    assert D.schema_changes(store.limit(0), table, stage=stage).count() == 0


def test_one_to_one(spark, stage):
    one = {f"t{i}": {"a": "v", "b": "v"} for i in range(4)}
    two = {f"t{i}": {"c": "v"} for i in range(4)}
    assert changes(spark, [("x", "s", one), ("y", "s", two)], stage) == [("y", "removed", "b", ""), ("y", "renamed", "a", "c")]


def test_unified_follows_the_chain(spark, stage):
    runs = [
        ("a", "s", {f"t{i}": {"path": f"p{i}", "n": i} for i in range(4)}),
        ("b", "s", {f"t{i}": {"spec": f"p{i}", "n": [i]} for i in range(4)}),
        ("c", "s", {f"t{i}": {"place": f"p{i}", "n": {"value": i}, "path": "again"} for i in range(4)}),
    ]
    store, table = world(spark, runs)
    found = D.schema_changes(store, table, stage=stage)
    counts = store.groupBy("run_id").count().withColumnRenamed("count", "n_records")
    versions = D.schema_versions(D.field_profile(D.explode_fields(store)), D.run_order(table, counts))
    rows = {(r["run_id"], r["task_id"]): (r["path"], r["n"]) for r in D.unified(store, D.field_routes(versions, found), ["path", "n"]).collect()}
    assert rows[("a", "t1")] == rows[("b", "t1")] == rows[("c", "t1")] == ("p1", "1")
    assert len(D.fingerprints(versions).select("fingerprint").distinct().collect()) == 3


def test_unified_keeps_every_field(spark, stage):
    runs = [
        ("a", "s", {f"t{i}": {"spec": f"p{i}", "tags": [i, 2], "unit": {"value": i, "unit": "s"}, "flag": True} for i in range(4)}),
        ("b", "s", {f"t{i}": {"path": f"p{i}", "tags": [i], "unit": {"value": i, "unit": "s"}, "Flag": False} for i in range(4)}),
        ("c", "s", {f"t{i}": {"path": f"p{i}", "tags": [], "unit": i} for i in range(4)}),
        ("d", "u", {f"t{i}": {"path": f"q{i}"} for i in range(4)}),
    ]
    runs[1][2]["t0"] |= {"rare": "x", "spec": "stray", "run_id": 7}
    store, table = world(spark, runs)
    counts = store.groupBy("run_id").count().withColumnRenamed("count", "n_records")
    versions = D.schema_versions(D.field_profile(D.explode_fields(store)), D.run_order(table, counts))
    routes = D.field_routes(versions, D.schema_changes(store, table, stage=stage))
    columns = D.canonical_columns(routes)
    assert [c for c in columns if c.lower() != "flag"] == ["path", "tags", "unit"] and len(columns) == 4
    found = D.unified(store, routes, columns).collect()
    rows = {(r["run_id"], r["task_id"]): r.asDict(recursive=True) for r in found}
    assert len(found) == 16
    assert [rows[x, "t1"]["path"] for x in "abcd"] == ["p1", "p1", "p1", "q1"]  # a chain that starts with an alias
    assert [rows[x, "t1"]["tags"] for x in "abc"] == ["[1, 2]", "1", "[]"]
    assert [rows[x, "t1"]["unit"] for x in "abc"] == ["1", "1", "1"]
    whole = {"field": "unit", "value": '{"unit": "s", "value": 0}'}
    others = {x["field"]: x["value"] for x in rows["b", "t0"]["other"]}
    assert others.items() >= {"rare": "x", "spec": "stray", "run_id": "7", "unit": whole["value"]}.items() and whole in rows["a", "t0"]["other"]
    assert rows["d", "t0"]["other"] == []
    held = lambda r: [v for k, v in r.items() if k.lower() == "flag"] + [x["value"] for x in r["other"] if x["field"] in ("flag", "Flag")]
    assert "true" in held(rows["a", "t0"]) and "false" in held(rows["b", "t0"])
