"""Semi-structured values: JSON, Python literals, and JSON inside chatter.

Whole JSON texts are handled by native expressions. Python literals and JSON
objects inside other text need a scanner that knows strings and escapes; those
are Arrow-batched UDFs and are only worth calling on rows the native path
leaves open.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

CONTRACT_KEYS = ["interface", "invariants", "postconditions", "preconditions"]


def is_object(text: Column) -> Column:
    """Whether a text is one JSON object and nothing else.

    The variant parser does not notice a trailing rest, so the text is parsed as
    the only element of an array. Objects with repeated keys are not accepted.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    first = F.schema_of_variant(F.try_variant_get(wrapped, "$[0]", "variant"))
    alone = F.try_variant_get(wrapped, "$[1]", "variant").isNull()
    return F.coalesce(first.startswith("OBJECT") & alone & F.regexp_like(text, F.lit(r"\}\s*$")), F.lit(False))


def keys(text: Column) -> Column:
    """Sorted top-level keys of a JSON object, null for anything else."""
    return F.when(is_object(text), F.array_sort(F.json_object_keys(text)))


def has_exact_keys(text: Column) -> Column:
    return F.coalesce(keys(text) == F.array(*map(F.lit, CONTRACT_KEYS)), F.lit(False))


def missing_keys(text: Column) -> Column:
    return F.array_sort(F.array_except(F.array(*map(F.lit, CONTRACT_KEYS)), keys(text)))


def extra_keys(text: Column) -> Column:
    return F.array_sort(F.array_except(keys(text), F.array(*map(F.lit, CONTRACT_KEYS))))


def canonical_contract(text: Column) -> Column:
    """The four parts of a contract as JSON text, from the object itself or from
    its member ``contract``; null if parts are missing in both."""
    def project(prefix: str) -> Column:
        parts = [F.get_json_object(text, f"$.{prefix}{k}") for k in CONTRACT_KEYS]
        complete = F.lit(True)
        for p in parts:
            complete = complete & p.isNotNull()
        body = F.concat(*[x for i, (k, p) in enumerate(zip(CONTRACT_KEYS, parts)) for x in (F.lit(("," if i else "{") + json.dumps(k) + ":"), p)], F.lit("}"))
        return F.when(complete, body)

    return F.when(is_object(text), F.coalesce(project(""), project("contract.")))


def contract_fault(text: Column) -> Column:
    """Why a text is no strict contract, null if it is one: missing, invalid_json,
    missing_keys, extra_keys or wrong_types."""
    names = keys(text)
    expected = F.array(*map(F.lit, CONTRACT_KEYS))
    parsed = F.try_parse_json(text)
    kind = lambda k: F.schema_of_variant(F.try_variant_get(parsed, f"$.{k}", "variant"))
    typed = kind("interface").startswith("OBJECT")
    for section in ("preconditions", "postconditions", "invariants"):
        typed = typed & kind(section).startswith("ARRAY")
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "missing").when(names.isNull(), "invalid_json")
        .when(F.size(F.array_except(expected, names)) > 0, "missing_keys").when(F.size(F.array_except(names, expected)) > 0, "extra_keys")
        .when(~F.coalesce(typed, F.lit(False)), "wrong_types")
    )


def contract_source(contract: Column, response: Column) -> Column:
    """Where a contract is to be taken from: parsed, raw or none. An explicit JSON null is none."""
    return (
        F.when(F.trim(contract) == "null", "none").when(canonical_contract(contract).isNotNull(), "parsed")
        .when(F.regexp_like(response, F.lit(r"\S")), "raw").otherwise("none")
    )


_BRACES = re.compile(r'\\.|"|[{}]', re.S)


def scan_object(text: str) -> str | None:
    """The first complete ``{...}`` of a text, braces inside strings aside; one pass.

    Where an outer brace is never closed, the first complete one inside counts."""
    opened, quoted = [], False
    best: tuple[int, int] | None = None
    for m in _BRACES.finditer(text, max(0, text.find("{"))):
        token = m.group()
        if token[0] == "\\":
            if quoted:
                continue
            token = token[1]
        if token == '"':
            quoted = not quoted
        elif quoted:
            continue
        elif token == "{":
            opened.append(m.end() - 1)
        elif token == "}" and opened:
            start = opened.pop()
            if best is None or start < best[0]:
                best = (start, m.end())
            if not opened:
                break
    return text[best[0]:best[1]] if best else None


def literal(text: str) -> object:
    """JSON, else a Python literal, else the text itself; blank is None."""
    if not text.strip():
        return None
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        pass
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.literal_eval(text.strip())
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return text


_FENCED = re.compile(r"```[A-Za-z0-9_+-]*\s*(.*?)```", re.S)
_BAD_ESCAPE = re.compile(r'\\(?!["\\/bfnrtu])')


def objects_in(text: str) -> Iterator[dict]:
    """JSON objects of a text: the whole text, fenced blocks, then objects in their
    order; of nested ones the outer, and the inner ones only where the outer does not parse."""
    for place in (text, *_FENCED.findall(text)):
        try:
            value = json.loads(place)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, dict):
            yield value
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
            yield value
        except (ValueError, RecursionError):
            end = at + 1
        at = text.find("{", end)


def first_object(text: str | None) -> dict | None:
    """The first JSON object of an answer."""
    return next(objects_in(text.strip()), None) if isinstance(text, str) else None


def as_mapping(text: str | None) -> dict:
    """A JSON or Python mapping, the empty one for anything else."""
    value = literal(text) if isinstance(text, str) else None
    return value if isinstance(value, dict) else {}


def find_contract(text: str) -> dict | None:
    """The first JSON object in a response that has all parts of a contract, itself or
    as its member ``contract``; looked for after reasoning, then in the whole response, each
    as it stands and then with backslashes doubled that start no JSON escape."""
    after = text.rsplit("</think>", 1)[-1]
    for place in dict.fromkeys((after, text)):
        for spelled in dict.fromkeys((place, _BAD_ESCAPE.sub(r"\\\\", place))):
            for value in objects_in(spelled.strip()):
                for held in (value, value.get("contract")):
                    if isinstance(held, dict) and all(k in held for k in CONTRACT_KEYS):
                        return {k: held[k] for k in CONTRACT_KEYS}
    return None


def without_keys(value: object, names: set[str]) -> object:
    """A nested value without the members of these names, at any depth."""
    if isinstance(value, dict):
        return {k: without_keys(v, names) for k, v in value.items() if k not in names}
    return [without_keys(v, names) for v in value] if isinstance(value, list) else value


def dump(value: object) -> str:
    """Canonical JSON text: sorted keys, no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


@F.pandas_udf(StringType())
def parse_jsonish_udf(texts: pd.Series) -> pd.Series:
    """Canonical JSON of JSON or Python literals, of other text as a JSON string."""
    return texts.map(lambda t: None if not isinstance(t, str) or (v := literal(t)) is None else dump(v))


@F.pandas_udf(StringType())
def find_contract_udf(texts: pd.Series) -> pd.Series:
    """Canonical JSON of the contract inside a response, null if there is none."""
    return texts.map(lambda t: dump(v) if isinstance(t, str) and (v := find_contract(t)) else None)


@F.pandas_udf(StringType())
def complete_object_udf(texts: pd.Series) -> pd.Series:
    """The first complete JSON-like object of a text."""
    return texts.map(lambda t: scan_object(t) if isinstance(t, str) else None)


@F.pandas_udf(StringType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    """SHA-256 of the canonical form of JSON texts."""
    import hashlib

    return texts.map(lambda t: hashlib.sha256(dump(literal(t)).encode("utf-8", "surrogatepass")).hexdigest() if isinstance(t, str) else None)


def _outside_strings(text: str) -> str:
    out, quoted, escaped = [], False, False
    for c in text:
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "​﻿":
            continue
        elif c.isspace() and c not in "\t\n\r":
            c = " "
        out.append(c)
    return "".join(out)


@F.pandas_udf(StringType())
def normalize_json_blanks_udf(texts: pd.Series) -> pd.Series:
    """Odd blanks made plain outside of JSON strings only."""
    return texts.map(lambda t: _outside_strings(t) if isinstance(t, str) else None)


def json_or_literal(text: Column) -> Column:
    """Parsed value as canonical JSON: native for whole JSON, the UDF elsewhere."""
    whole = F.to_json(F.try_parse_json(text))
    return F.when(is_object(text), whole).otherwise(parse_jsonish_udf(F.when(~is_object(text), text)))


@F.pandas_udf(StringType())
def first_object_udf(texts: pd.Series) -> pd.Series:
    """The first JSON object of each answer as JSON with sorted keys."""
    return texts.map(lambda t: json.dumps(v, sort_keys=True) if (v := first_object(t)) is not None else None)


def unwrapped_ids(text: Column) -> Column:
    """Ids of a JSON list that may lie in lists of one element each, null for any other value."""
    inner = F.regexp_extract(text, r"^\s*\[[\s\[]*([-\d,\s]*)[\s\]]*\]\s*$", 1)
    fits = F.regexp_like(text, F.lit(r"^\s*\[[\s\[]*[-\d,\s]*[\s\]]*\]\s*$"))
    ids = F.from_json(F.concat(F.lit("["), inner, F.lit("]")), "array<bigint>")
    return F.when(fits, ids)
