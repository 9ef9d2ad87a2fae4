"""Array and number expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading elements that two arrays share."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, F.lit(False))
    return F.when(at > 0, at - 1).otherwise(F.least(F.size(a), F.size(b)).cast("long"))


def mask_prefix(ids: Column, n: Column, ignored: int = -100) -> Column:
    """Labels: the first n ids are ignored, the rest is kept."""
    n = F.least(n, F.size(ids)).cast("int")
    return F.concat(F.array_repeat(F.lit(ignored), n), F.slice(ids, n + 1, F.size(ids)))


def pad(ids: Column, length: Column, filler: int) -> Column:
    """Right-padded to a length."""
    return F.concat(ids, F.array_repeat(F.lit(filler), F.greatest(F.lit(0), (length - F.size(ids)).cast("int"))))


def ratio(part: Column, whole: Column) -> Column:
    """Share with 0 for an empty whole."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def rounded(value: Column, digits: int) -> Column:
    """Half-even rounding."""
    return F.bround(value, digits)


def validation_count(n: Column, share: float) -> Column:
    """Rows of a stratum that go to validation: rounded share, at least one, never all; none of a single row."""
    wanted = F.bround(n * F.lit(share), 0).cast("long")
    return F.when(n <= 1, F.lit(0).cast("long")).otherwise(F.least(F.greatest(F.lit(1), wanted), n - 1))


def index_p95(values: Column) -> Column:
    """Element number int(0.95 n) of the sorted array, counted from 1, at least the first."""
    n = F.size(values)
    at = F.greatest(F.lit(1), F.least(n, F.floor(n * F.lit(0.95)).cast("int")))
    return F.element_at(F.array_sort(values), at)


def unwrap_ids(ids: Column) -> Column:
    """Ids of a text from nested lists: the inner lists one after the other."""
    return F.flatten(ids)


def replace_at(items: Column, index: Column, value: Column) -> Column:
    """The array with another element at a position counted from 0; out of range changes nothing."""
    return F.transform(items, lambda x, i: F.when(i == index, value).otherwise(x))


def append_or_replace(items: Column, index: Column, value: Column) -> Column:
    """As :func:`replace_at`, and one past the end appends."""
    return F.when(index == F.size(items), F.array_append(items, value)).otherwise(replace_at(items, index, value))


def integer_keys(entries: Column) -> Column:
    """A map whose text keys become integers; left out where a key is none."""
    return F.map_from_entries(
        F.filter(
            F.transform(F.map_entries(entries), lambda e: F.struct(e["key"].try_cast("bigint").alias("key"), e["value"].alias("value"))),
            lambda e: e["key"].isNotNull(),
        )
    )
