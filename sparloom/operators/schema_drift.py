"""Schema drift between runs that follow each other.

Every run is a schema version of its series. :func:`field_profile` reduces the
records to one small row per run and top-level key; :func:`schema_versions`
keeps the fields a run *has* (at least half of its records carry the key, null
or not) with a fingerprint; :func:`schema_changes` compares each version with
the one before and names renames by their values; :func:`unified` routes every
record through the chain of rename, default and cast steps of its series.

Record-sized data meets itself once only: the values of vanished and new fields
of neighbouring versions are joined on (version pair, task). Everything after
that is metadata, some rows per run.

Defined results: the identifier key is no field; a run without records is no
version (its neighbours are compared with each other); ties in ``started_at``
are broken by ``run_id``; a field that only holds nulls has no type and is never
retyped; of equally common types the first in alphabetical order counts; two
nulls are no equal values; each vanished field is renamed at most once, and
each new one is the target of at most one rename (most equal values first,
then by name). Runs missing from the run table belong to no series and are left
out. An empty store gives empty results.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

FIELD_SCHEMA = "run_id string, task_id string, field string, kind string, value string, value_hash long"
HASH_SCHEMA = "run_id string, task_id string, field string, kind string, value_hash long"
KINDS = {str: "string", bool: "boolean", int: "number", float: "number", list: "array", dict: "object", type(None): None}


def _plain(value):
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value


def _fields(keep_values: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for run_id, task_id, record in zip(pdf["run_id"], pdf["task_id"], pdf["record"]):
                for key, value in json.loads(record).items():
                    if key == "task_id":
                        continue
                    key = key.encode("utf-8", "replace").decode()
                    kind = KINDS[type(value)]
                    text = None if kind is None else json.dumps(_plain(value), sort_keys=True)
                    digest = None if text is None else int.from_bytes(
                        hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)
                    rows.append((run_id, task_id, key, kind, text, digest) if keep_values else (run_id, task_id, key, kind, digest))
            names = ["run_id", "task_id", "field", "kind", "value", "value_hash"] if keep_values else ["run_id", "task_id", "field", "kind", "value_hash"]
            out = pd.DataFrame(rows, columns=names)
            out["value_hash"] = out["value_hash"].astype("Int64")
            yield out

    return run


def explode_fields(store: DataFrame, keep_values: bool = False) -> DataFrame:
    """One row per record and top-level key (map-only)."""
    return store.select("run_id", "task_id", "record").mapInPandas(_fields(keep_values), FIELD_SCHEMA if keep_values else HASH_SCHEMA)


def run_order(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """run_id, series, version (1, 2, ...), previous run_id and n_records of each run that has records."""
    w = W.partitionBy("series").orderBy("started_at", "run_id")
    return (
        runs.select("run_id", "series", "started_at").dropDuplicates(["run_id"])
        .join(counts, "run_id")
        .withColumn("version", F.row_number().over(w))
        .withColumn("prev_run_id", F.lag("run_id").over(w))
        .drop("started_at")
    )


def field_profile(fields: DataFrame) -> DataFrame:
    """run_id, field, n_present, kind (the most common JSON type)."""
    per_kind = fields.groupBy("run_id", "field", "kind").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by("kind", F.struct(F.when(F.col("kind").isNull(), 1).otherwise(0), -F.col("n"), F.col("kind")))
    return per_kind.groupBy("run_id", "field").agg(F.sum("n").alias("n_present"), best.alias("kind"))


def schema_versions(profile: DataFrame, order: DataFrame) -> DataFrame:
    """run_id, series, version, prev_run_id, field, kind of the fields each version has."""
    return profile.join(order, "run_id").where(F.col("n_present") * 2 >= F.col("n_records"))


def fingerprints(versions: DataFrame) -> DataFrame:
    """One row per run: its fields with their types, and their hash."""
    listed = F.array_sort(F.collect_list(F.concat_ws(":", "field", F.coalesce("kind", F.lit("null")))))
    return (
        versions.groupBy("series", "version", "run_id").agg(listed.alias("fields"))
        .withColumn("fingerprint", F.sha2(F.concat_ws(",", "fields"), 256))
    )


def _one_to_one(pdf: pd.DataFrame) -> pd.DataFrame:
    used_old, used_new, keep = set(), set(), []
    for row in pdf.sort_values(["n_equal", "field", "new_field"], ascending=[False, True, True]).itertuples():
        if row.field not in used_old and row.new_field not in used_new:
            used_old.add(row.field)
            used_new.add(row.new_field)
            keep.append((row.run_id, row.field, row.new_field))
    return pd.DataFrame(keep, columns=["run_id", "field", "new_field"])


def changed_pairs(order: DataFrame, versions: DataFrame) -> DataFrame:
    """run_id, prev_run_id of neighbours whose fingerprints differ; equal ones have nothing to migrate."""
    prints = fingerprints(versions).select("run_id", "fingerprint")
    before = prints.select(F.col("run_id").alias("prev_run_id"), F.col("fingerprint").alias("prev_fingerprint"))
    neighbours = order.where(F.col("prev_run_id").isNotNull()).select("run_id", "prev_run_id")
    met = neighbours.join(prints, "run_id", "left").join(before, "prev_run_id", "left")
    return met.where(~F.col("fingerprint").eqNullSafe(F.col("prev_fingerprint"))).select("run_id", "prev_run_id")


def schema_changes(store: DataFrame, runs: DataFrame, rename_share: float = 0.6, stage=lambda df, label: df, fields: DataFrame | None = None) -> DataFrame:
    """run_id, change, field, new_field: what each run changes against the run before it.

    Only versions whose fingerprint differs from the one before are compared.
    ``fields`` are the fields of the store where they are at hand.
    ``rename_share`` is the share of shared tasks (with a value on both sides)
    that must hold an equal value of an equal type.
    """
    fields = stage(explode_fields(store), "fields") if fields is None else fields
    counts = store.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_records"))
    order = stage(run_order(runs, counts), "order")
    versions = stage(schema_versions(field_profile(fields), order), "versions")
    pairs = stage(changed_pairs(order, versions), "pairs")
    later = versions.select("run_id", "field", F.col("kind").alias("new_kind"), F.lit(1).alias("in_new"))
    earlier = pairs.join(
        versions.select(F.col("run_id").alias("prev_run_id"), "field", F.col("kind").alias("old_kind")), "prev_run_id"
    ).select("run_id", "field", "old_kind", F.lit(1).alias("in_old"))
    both = stage(
        later.join(pairs.select("run_id"), "run_id").join(earlier, ["run_id", "field"], "full_outer"), "compared"
    )
    gone = both.where(F.col("in_new").isNull()).select("run_id", "field")
    new = both.where(F.col("in_old").isNull()).select("run_id", "field")
    retyped = both.where(F.col("in_new").isNotNull() & F.col("in_old").isNotNull() & (F.col("new_kind") != F.col("old_kind")))

    # values of vanished fields, from the earlier run, and of new ones, from the later
    value = ["task_id", "kind", "value_hash"]
    filled = fields.where(F.col("kind").isNotNull())
    old_values = (
        filled.withColumnRenamed("run_id", "prev_run_id")
        .join(gone.join(pairs, "run_id").select("prev_run_id", "field", F.col("run_id")), ["prev_run_id", "field"])
        .select("run_id", F.col("field"), *value)
    )
    new_values = filled.join(new, ["run_id", "field"]).select(
        "run_id", F.col("field").alias("new_field"), "task_id", F.col("kind").alias("new_kind"), F.col("value_hash").alias("new_hash")
    )
    same = ((F.col("kind") == F.col("new_kind")) & (F.col("value_hash") == F.col("new_hash"))).cast("long")
    matched = (
        old_values.join(new_values, ["run_id", "task_id"])
        .groupBy("run_id", "field", "new_field")
        .agg(F.count(F.lit(1)).alias("n_shared"), F.sum(same).alias("n_equal"))
        .where(F.col("n_equal") >= F.col("n_shared") * rename_share)
    )
    renamed = stage(
        matched.groupBy("run_id").applyInPandas(_one_to_one, "run_id string, field string, new_field string"), "renamed"
    )
    none = F.lit("")
    removed = gone.join(renamed, ["run_id", "field"], "left_anti")
    added = new.join(renamed.select("run_id", F.col("new_field").alias("field")), ["run_id", "field"], "left_anti")
    out = lambda df, change, target=none: df.select("run_id", F.lit(change).alias("change"), "field", target.alias("new_field"))
    return (
        out(added, "added")
        .unionByName(out(removed, "removed"))
        .unionByName(out(renamed, "renamed", F.col("new_field")))
        .unionByName(out(retyped, "retyped"))
    )


def _chains(pdf: pd.DataFrame) -> pd.DataFrame:
    """Canonical name of every field of every version of one series: of the
    names that renames link, the one that most versions of all series have."""
    name, rows, anew = {}, [], set()
    for _, group in pdf.sort_values(["version", "field"]).groupby("version", sort=True):
        renames = dict(zip(group["field"], group["old_field"]))
        step = {}
        for field, old in renames.items():
            step[field] = name.get(old, old) if isinstance(old, str) else name.get(field, field)
        taken: dict[str, str] = {}
        for field in sorted(step, key=lambda f: (not isinstance(renames[f], str), f)):
            canonical = step[field]
            if canonical in taken:  # a name freed by a rename and used anew is a field of its own
                canonical = f"{field}__v{group['version'].iloc[0]}"
                anew.add(canonical)
            taken[canonical] = field
            step[field] = canonical
        name.update(step)
        rows += [(group["run_id"].iloc[0], field, canonical) for field, canonical in step.items()]
    uses = dict(zip(pdf["field"], pdf["n_uses"]))
    linked: dict[str, list[str]] = {}
    for _, field, chain in rows:
        if field not in linked.setdefault(chain, []):
            linked[chain].append(field)
    best: dict[str, str] = {}
    for chain, names in sorted(linked.items(), key=lambda x: (x[0] in anew, len(x[1]))):
        free = [n for n in names if n not in best.values()]
        best[chain] = chain if chain in anew or not free else max(free, key=lambda n: uses[n])
    return pd.DataFrame([(run, field, best[chain]) for run, field, chain in rows], columns=["run_id", "field", "canonical"])


def field_routes(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """run_id, field, canonical: the chained renames of each series.

    Rows here are fields of versions, a bounded amount for each series.
    """
    renames = changes.where("change = 'renamed'").select("run_id", F.col("new_field").alias("field"), F.col("field").alias("old_field"))
    return (
        versions.select("series", "version", "run_id", "field").join(renames, ["run_id", "field"], "left")
        .join(versions.groupBy("field").agg(F.count(F.lit(1)).alias("n_uses")), "field")
        .groupBy("series").applyInPandas(_chains, "run_id string, field string, canonical string")
    )


def cast_text(kind: Column, value: Column) -> Column:
    """Cast rule of a scalar column: arrays of one element and ``{"value": x}`` or
    ``{"name": x}`` objects are unwrapped, quotes of strings are removed."""
    unwrapped = (
        F.when((kind == "array") & (F.json_array_length(value) == 1), F.get_json_object(value, "$[0]"))
        .when(kind == "object", F.coalesce(F.get_json_object(value, "$.value"), F.get_json_object(value, "$.name"), F.get_json_object(value, "$.path"), value))
        .when(kind == "string", F.get_json_object(F.concat(F.lit('{"x":'), value, F.lit("}")), "$.x"))
        .otherwise(value)
    )
    return unwrapped


KEYS = ("run_id", "task_id", "other")


def canonical_columns(routes: DataFrame) -> list[str]:
    """Canonical names of all routes that can be columns beside each other: not
    a key, and the first of those that differ by case only."""
    names, seen = [], set(KEYS)
    for row in routes.select("canonical").distinct().orderBy("canonical").collect():
        if row["canonical"].lower() not in seen:
            seen.add(row["canonical"].lower())
            names.append(row["canonical"])
    return names


def migration_steps(changes: DataFrame, versions: DataFrame) -> DataFrame:
    """run_id, rule, field, target, from_kind, to_kind: the explicit steps from each version to its successor.

    ``rename`` moves the values of a field to its new name, ``default`` gives a field that
    one side lacks null there (target is the field itself), ``cast`` changes the type of a field.
    """
    own = versions.select("run_id", F.col("field").alias("target"), F.col("kind").alias("to_kind"))
    before = versions.select("run_id", "prev_run_id").distinct().join(
        versions.select(F.col("run_id").alias("prev_run_id"), "field", F.col("kind").alias("from_kind")), "prev_run_id"
    ).select("run_id", "field", "from_kind")
    rule = F.when(F.col("change") == "renamed", "rename").when(F.col("change") == "retyped", "cast").otherwise("default")
    steps = changes.select("run_id", rule.alias("rule"), "field", F.coalesce(F.nullif(F.col("new_field"), F.lit("")), F.col("field")).alias("target"))
    return steps.join(own, ["run_id", "target"], "left").join(before, ["run_id", "field"], "left").select("run_id", "rule", "field", "target", "from_kind", "to_kind")


def unified(store: DataFrame, routes: DataFrame, columns: list[str], fields: DataFrame | None = None) -> DataFrame:
    """Every record as one row with the same columns: fields are renamed to
    their canonical name, cast by :func:`cast_text`, absent ones are null.

    Nothing else vanishes: ``other`` lists, by name, the fields without a column
    (a stray field whose name is another field's column in this run is one) and,
    as they were, the objects of which a column only holds one member.
    """
    fields = (explode_fields(store, keep_values=True) if fields is None else fields).where(F.col("kind").isNotNull())
    targets = routes.select("run_id", F.col("canonical").alias("field"), F.lit(True).alias("is_target")).distinct()
    routed = fields.join(routes, ["run_id", "field"], "left").join(targets, ["run_id", "field"], "left")
    name = F.coalesce("canonical", F.when(F.col("is_target").isNull(), F.col("field")))
    routed = routed.withColumn("at", F.when(name.isin(columns), name)).withColumn("text", cast_text(F.col("kind"), F.col("value")))
    partly = (F.col("kind") == "object") & (F.size(F.json_object_keys("value")) > 1) & (F.col("text") != F.col("value"))
    kept = F.when(partly, F.struct("field", "value")).when(F.col("at").isNull(), F.struct("field", F.coalesce("text", "value").alias("value")))
    cells = (
        routed.withColumn("kept", kept).groupBy("run_id", "task_id")
        .agg(*[F.max(F.when(F.col("at") == c, F.col("text"))).alias(c) for c in columns], F.array_sort(F.collect_list("kept")).alias("other"))
    )
    return store.select("run_id", "task_id").join(cells, ["run_id", "task_id"], "left")
