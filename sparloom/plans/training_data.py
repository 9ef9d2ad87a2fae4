"""Queries of the general training-data operators (problems 1 and 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparloom.operators import schema_drift, small_files
from sparloom.storage import staged, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of the consolidated store."""
    return small_files.consolidated_store(spark, sf_dir).select("run_id", "task_id")


def p1_store_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the store with their records and text volume."""
    store = small_files.consolidated_store(spark, sf_dir)
    return store.groupBy(F.col("_metadata.file_name").alias("file_name")).agg(
        F.count(F.lit(1)).alias("n_records"), F.sum(F.length("record")).alias("n_chars")
    )


def _drift(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The store in more and smaller files, as parsing them again is most of the work, and the runs."""
    return small_files.consolidated_store(spark, sf_dir, target_file_bytes=8 << 20), table(spark, sf_dir, "gen_run")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes of each run against the run before it."""
    return schema_drift.schema_changes(*_drift(spark, sf_dir), stage=staged)


def _versions(store: DataFrame, runs: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    counts = store.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_records"))
    profile = schema_drift.field_profile(schema_drift.explode_fields(store) if fields is None else fields)
    return staged(schema_drift.schema_versions(profile, schema_drift.run_order(runs, counts)), "versions")


def p3_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema fingerprint of each run."""
    return schema_drift.fingerprints(_versions(*_drift(spark, sf_dir))).withColumn("fields", F.concat_ws(",", "fields"))


def p3_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The migration steps from each version to the next, with types."""
    store, runs = _drift(spark, sf_dir)
    fields = staged(schema_drift.explode_fields(store), "fields")
    return schema_drift.migration_steps(schema_drift.schema_changes(store, runs, stage=staged, fields=fields), _versions(store, runs, fields))


def p3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records in one table with consistent columns, one for each canonical field of the runs."""
    store, runs = _drift(spark, sf_dir)
    fields = staged(schema_drift.explode_fields(store, keep_values=True), "fields")
    changes = schema_drift.schema_changes(store, runs, stage=staged, fields=fields)
    routes = staged(schema_drift.field_routes(_versions(store, runs, fields), changes), "routes")
    return schema_drift.unified(store, routes, schema_drift.canonical_columns(routes), fields)


QUERIES = {
    "p1_found": p1_found, "p1_store_files": p1_store_files,
    "p3_found": p3_found, "p3_versions": p3_versions, "p3_steps": p3_steps, "p3_unified": p3_unified,
}
RECORDS_SQL = """
f AS (SELECT run_id, regexp_extract(file_path, '[^/]*$') AS name, content, CASE WHEN json_valid(content) THEN json_type(content) ELSE 'LINES' END AS kind FROM raw_file WHERE content IS NOT NULL),
g AS (SELECT * FROM f WHERE NOT starts_with(name, '_')),
lines AS (SELECT run_id, name, unnest(string_split(content, chr(10))) AS l FROM g WHERE kind = 'LINES'),
r AS (SELECT run_id, name, content::VARCHAR AS rec FROM g WHERE kind = 'OBJECT'
  UNION ALL SELECT run_id, name, unnest(json_extract(content, '$[*]'))::VARCHAR FROM g WHERE kind = 'ARRAY'
  UNION ALL SELECT run_id, name, l FROM lines WHERE json_valid(l)),
o AS (SELECT run_id, coalesce(nullif(nullif(json_extract_string(rec, '$.task_id'), ''), 'None'), split_part(name, '.', 1)) AS task_id, rec FROM r WHERE json_type(rec) = 'OBJECT'),
store AS (SELECT run_id, task_id, min(rec) AS rec FROM o GROUP BY 1, 2)
"""
CHANGES_SQL = f"""
{RECORDS_SQL},
k AS (SELECT run_id, task_id, rec, unnest(json_keys(rec)) AS field FROM store),
v AS (SELECT run_id, task_id, field, json_extract(rec, '$."' || field || '"') AS val,
  CASE json_type(rec, '$."' || field || '"') WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind
  FROM k WHERE field <> 'task_id'),
n AS (SELECT run_id, count(*) AS n FROM store GROUP BY 1),
per AS (SELECT run_id, field, kind, count(*) AS c FROM v GROUP BY 1, 2, 3),
prof AS (SELECT run_id, field, sum(c) AS c, (list(kind ORDER BY kind IS NULL, c DESC, kind))[1] AS kind FROM per GROUP BY 1, 2),
has AS (SELECT p.run_id, field, kind FROM prof p JOIN n USING (run_id) WHERE p.c * 2 >= n.n),
ord AS (SELECT run_id, lag(run_id) OVER (PARTITION BY series ORDER BY started_at, run_id) AS prev FROM gen_run SEMI JOIN n USING (run_id)),
pairs AS (SELECT * FROM ord WHERE prev IS NOT NULL),
gone AS (SELECT p.run_id, p.prev, h.field FROM pairs p JOIN has h ON h.run_id = p.prev ANTI JOIN has x ON x.run_id = p.run_id AND x.field = h.field),
fresh AS (SELECT p.run_id, p.prev, h.field FROM pairs p JOIN has h ON h.run_id = p.run_id ANTI JOIN has x ON x.run_id = p.prev AND x.field = h.field),
m AS (SELECT g.run_id, g.field, w.field AS new_field, count(*) AS shared, count(*) FILTER (a.kind = b.kind AND a.val::VARCHAR = b.val::VARCHAR) AS same
  FROM gone g JOIN fresh w ON w.run_id = g.run_id JOIN v a ON a.run_id = g.prev AND a.field = g.field AND a.kind IS NOT NULL
  JOIN v b ON b.run_id = g.run_id AND b.field = w.field AND b.task_id = a.task_id AND b.kind IS NOT NULL GROUP BY 1, 2, 3),
ren AS (SELECT run_id, field, new_field FROM m WHERE same >= shared * 0.6),
retyped AS (SELECT p.run_id, a.field FROM pairs p JOIN has a ON a.run_id = p.prev JOIN has b ON b.run_id = p.run_id AND b.field = a.field WHERE a.kind <> b.kind)
"""
ORACLE: dict[str, str] = {
    "p1_found": f"WITH {RECORDS_SQL} SELECT run_id, task_id FROM store",
    "p3_found": f"""WITH {CHANGES_SQL} SELECT run_id, 'renamed' AS change, field, new_field FROM ren
UNION ALL SELECT g.run_id, 'removed', g.field, '' FROM gone g ANTI JOIN ren USING (run_id, field)
UNION ALL SELECT w.run_id, 'added', w.field, '' FROM fresh w ANTI JOIN ren ON ren.run_id = w.run_id AND ren.new_field = w.field
UNION ALL SELECT run_id, 'retyped', field, '' FROM retyped""",
    "p3_steps": f"""WITH {CHANGES_SQL}, steps AS (SELECT run_id, 'rename' AS rule, field, new_field AS target FROM ren
UNION ALL SELECT g.run_id, 'default', g.field, g.field FROM gone g ANTI JOIN ren USING (run_id, field)
UNION ALL SELECT w.run_id, 'default', w.field, w.field FROM fresh w ANTI JOIN ren ON ren.run_id = w.run_id AND ren.new_field = w.field
UNION ALL SELECT run_id, 'cast', field, field FROM retyped)
SELECT s.run_id, s.rule, s.field, s.target, a.kind AS from_kind, b.kind AS to_kind FROM steps s JOIN pairs p ON p.run_id = s.run_id
LEFT JOIN has a ON a.run_id = p.prev AND a.field = s.field LEFT JOIN has b ON b.run_id = s.run_id AND b.field = s.target""",
    "p3_versions": f"""WITH {CHANGES_SQL}, o2 AS (SELECT run_id, series, row_number() OVER (PARTITION BY series ORDER BY started_at, run_id) AS version FROM gen_run SEMI JOIN n USING (run_id)),
l AS (SELECT o2.series, o2.version::INT AS version, o2.run_id, array_to_string(list_sort(list(field || ':' || coalesce(kind, 'null'))), ',') AS fields FROM has JOIN o2 USING (run_id) GROUP BY 1, 2, 3)
SELECT *, sha256(fields) AS fingerprint FROM l""",
}
