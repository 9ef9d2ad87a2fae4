"""Deterministic checks of contracts.

Structural rules are native expressions over the contract struct; each yields an
array of issues, and the arrays are concatenated, so a contract is judged in one
pass without a shuffle. Rules about expressions need a Python parser and run in
one Arrow-batched UDF (:mod:`sparloom.operators.verifier`).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from sparloom.operators.verifier import expression_issues_udf

SECTIONS = {"preconditions": "P", "postconditions": "Q", "invariants": "I"}
MODES = ["functional", "stdin_stdout"]
OUTPUT_NAMES = r"\b(?:stdout|return_value|result|output)\b"


def issue(kind: str, location: Column, action: str) -> Column:
    return F.struct(F.lit(kind).alias("type"), location.cast("string").alias("location"), F.lit(action).alias("action"))


def _when(condition: Column, what: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(what)).otherwise(F.filter(F.array(what), lambda _: F.lit(False)))


def _blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def clause_issues(contract: Column, section: str) -> Column:
    """Issues of the clauses of one section: id missing, with the wrong letter or
    out of sequence, blank expression or description, output named in a precondition."""
    letter = SECTIONS[section]
    clauses = F.coalesce(contract[section], F.filter(contract["preconditions"], lambda _: F.lit(False)))

    def of(clause: Column, i: Column) -> Column:
        at = F.concat(F.lit(section + "["), i.cast("string"), F.lit("]"))
        found = [
            _when(_blank(clause["id"]), issue("missing_id", at, "replace")),
            _when(~_blank(clause["id"]) & ~clause["id"].startswith(letter), issue("wrong_id_letter", at, "replace")),
            _when(~_blank(clause["id"]) & clause["id"].startswith(letter) & (clause["id"] != F.concat(F.lit(letter), (i + 1).cast("string"))), issue("id_out_of_sequence", at, "replace")),
            _when(_blank(clause["expression"]), issue("missing_expression", at, "replace")),
            _when(_blank(clause["description"]), issue("missing_description", at, "replace")),
        ]
        if section == "preconditions":
            found.append(_when(F.regexp_like(clause["expression"], F.lit(OUTPUT_NAMES)), issue("output_in_precondition", at, "remove")))
        return F.concat(*found)

    return F.flatten(F.transform(clauses, of))


def structure_issues(contract: Column) -> Column:
    """All native issues of a contract, in a fixed order."""
    face = contract["interface"]
    stdin = face["mode"] == "stdin_stdout"
    none = F.lit("interface")
    head = F.concat(
        _when(contract.isNull(), issue("missing_contract", F.lit("contract"), "add")),
        _when(contract.isNotNull() & face.isNull(), issue("missing_interface", none, "add")),
        _when(face.isNotNull() & F.coalesce(~face["mode"].isin(MODES), F.lit(True)), issue("invalid_mode", F.lit("interface.mode"), "replace")),
        _when((face["mode"] == "functional") & _blank(face["function_name"]), issue("missing_function_name", F.lit("interface.function_name"), "add")),
        _when(stdin & F.coalesce(face["signature"] != "stdin -> stdout", F.lit(True)), issue("invalid_signature", F.lit("interface.signature"), "replace")),
        _when(stdin & F.coalesce((face["input_channel"] != "stdin") | (face["output_channel"] != "stdout"), F.lit(True)), issue("invalid_channels", none, "replace")),
        _when(contract.isNotNull() & (F.coalesce(F.size(contract["postconditions"]), F.lit(0)) == 0), issue("missing_clause", F.lit("postconditions"), "add")),
    )
    return F.concat(head, *[F.coalesce(clause_issues(contract, s), F.filter(head, lambda _: F.lit(False))) for s in SECTIONS])


def expression_issues(df: DataFrame, contract: str, key: str) -> DataFrame:
    """(key, location, code, detail) of all clause expressions of all contracts."""
    located = lambda section: F.transform(
        F.col(contract)[section], lambda c, i: F.struct(F.concat(F.lit(section + "["), i.cast("string"), F.lit("].expression")).alias("location"), c["expression"].alias("expression"))
    )
    every = F.concat(*[F.coalesce(located(section), F.array().cast("array<struct<location:string,expression:string>>")) for section in SECTIONS])
    clauses = df.select(key, F.explode(every).alias("c")).select(key, "c.location", "c.expression")
    return clauses.select(key, "location", F.explode(expression_issues_udf("expression")).alias("i")).select(key, "location", "i.code", "i.detail")


LOCATION = re.compile(r"^(?:interface(?:\.\w+)?|(?:preconditions|postconditions|invariants)(?:\[\d+\])?)$")


def location_valid(location: Column, contract: Column) -> Column:
    """Whether a location names the interface, one of its fields, a section, or a clause that exists."""
    shape = F.regexp_like(location, F.lit(LOCATION.pattern))
    index = F.try_to_number(F.nullif(F.regexp_extract(location, r"\[(\d+)\]", 1), F.lit("")), F.lit("9999999999")).cast("int")
    size = F.lit(0)
    for section in SECTIONS:
        size = F.when(location.startswith(section), F.coalesce(F.size(contract[section]), F.lit(0))).otherwise(size)
    return F.coalesce(shape & (index.isNull() | (index < size)), F.lit(False))


def grounded(evidence: Column, question: Column) -> Column:
    """Whether evidence, case and blanks aside, is part of the question."""
    from sparloom.functions.text import collapse

    return F.coalesce(F.contains(collapse(question), collapse(evidence)) & (F.length(F.trim(evidence)) > 0), F.lit(False))


def renumbered(clauses: Column, letter: str, most: int = 12) -> Column:
    """At most ``most`` clauses, numbered from 1."""
    return F.transform(F.slice(clauses, 1, most), lambda c, i: c.withField("id", F.concat(F.lit(letter), (i + 1).cast("string"))))


def distinct_issues(issues: Column) -> Column:
    """The first issue of each (type, location, action), in order."""
    same = lambda a, b: (a["type"] == b["type"]) & (a["location"].eqNullSafe(b["location"])) & (a["action"].eqNullSafe(b["action"]))
    return F.filter(issues, lambda x, i: ~F.exists(F.slice(issues, 1, i), lambda y: same(x, y)))
