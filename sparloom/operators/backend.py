"""Calls of a text model from Spark, and bounded verify-and-repair loops.

A backend is anything with ``generate(prompts) -> responses``. It is built once
for each partition, on the first row that needs it, and called in batches; a
failed call becomes a row with its error. Deterministic checks belong before
these operators, as filters, so that only undecided rows reach a model.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F


class Backend(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class TemplateBackend:
    """A deterministic stand-in: answers with a template and the prompt's hash."""

    def __init__(self, template: str = "{digest}"):
        self.template = template

    def generate(self, prompts: list[str]) -> list[str]:
        return [self.template.format(digest=hashlib.sha256(p.encode()).hexdigest()[:16], prompt=p) for p in prompts]


class FatalError(Exception):
    """An error that another try cannot mend."""


def with_retries(call: Callable[[], list[str]], retries: int, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """Call again after 1, 2, 4, ... up to 30 seconds."""
    for attempt in range(retries + 1):
        try:
            return call()
        except FatalError:
            raise
        except Exception:
            if attempt == retries:
                raise
            sleep(min(2.0 ** attempt, 30.0))
    raise AssertionError


class HttpBackend:
    """A model behind HTTP: prompts are posted one by one as JSON, the answer has ``field``.

    A status of 400 to 499 is fatal, any other failure may be tried again."""

    def __init__(self, url: str, field: str = "response", timeout: float = 600.0, settings: dict | None = None):
        self.url, self.field, self.timeout, self.settings = url, field, timeout, settings or {}

    def generate(self, prompts: list[str]) -> list[str]:
        import urllib.error
        import urllib.request

        out = []
        for prompt in prompts:
            body = json.dumps({**self.settings, "prompt": prompt}).encode()
            request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    out.append(str(json.load(answer)[self.field]))
            except urllib.error.HTTPError as error:
                if 400 <= error.code < 500:
                    raise FatalError(f"{self.url} answered {error.code}") from error
                raise
        return out


def until_valid(call: Callable[[], str], read: Callable[[str], dict], tries: int = 2) -> dict:
    """Call again until ``read`` accepts the answer: its value, or the last error, with the number of calls."""
    errors: list[str] = []
    for n in range(1, tries + 1):
        got = read(call())
        if got.get("valid"):
            return {"ok": True, "value": got, "calls": n, "errors": errors}
        errors.append(got.get("error", "invalid"))
    return {"ok": False, "value": None, "calls": tries, "errors": errors}


def stopped(text: str, stops: list[str]) -> str:
    """A response up to the first of its stop texts."""
    cuts = [at for stop in stops if stop and (at := text.find(stop)) >= 0]
    return text[:min(cuts)] if cuts else text


def generate(df: DataFrame, prompt: str, make: Callable[[], Backend], retries: int = 2, batch: int = 16) -> DataFrame:
    """``df`` with ``response`` and ``error``. A null prompt gives neither."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", response string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend: Backend | None = None
        for pdf in batches:
            responses: list[str | None] = [None] * len(pdf)
            errors: list[str | None] = [None] * len(pdf)
            todo = [i for i, p in enumerate(pdf[prompt]) if isinstance(p, str)]
            for at in range(0, len(todo), batch):
                part = todo[at:at + batch]
                try:
                    backend = backend or make()
                    own = backend
                    got = with_retries(lambda: own.generate([pdf[prompt].iloc[i] for i in part]), retries)
                    for i, response in zip(part, got):
                        responses[i] = response
                except Exception as error:
                    for i in part:
                        errors[i] = f"{type(error).__name__}: {error}"
            yield pdf.assign(response=responses, error=errors)

    return df.mapInPandas(run, schema)


def repair_loop(
    df: DataFrame, key: str, value: str, faults: Callable[[str], list[str]], repair: Callable[[str, str, int], str | None], most: int = 5
) -> DataFrame:
    """key, value, resolved, attempts, left: each value is repaired until it has no fault.

    ``repair(value, fault, attempt)`` proposes a new value or None. A proposal
    that was tried before, or has no fewer faults, is not taken. At most ``most``
    attempts are made; one row comes out for each row that goes in.
    """

    def one(text: str) -> tuple[str, bool, int, str | None]:
        seen = {hashlib.sha256(text.encode()).digest()}
        found = faults(text)
        attempt = 0
        while found and attempt < most:
            attempt += 1
            candidate = repair(text, found[0], attempt)
            if candidate is None:
                continue
            digest = hashlib.sha256(candidate.encode()).digest()
            if digest in seen:
                continue
            seen.add(digest)
            after = faults(candidate)
            if len(after) < len(found):
                text, found = candidate, after
        return text, not found, attempt, ",".join(found) or None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [one(v) if isinstance(v, str) else (None, False, 0, "missing") for v in pdf["value_"]]
            out = pd.DataFrame(rows, columns=["value", "resolved", "attempts", "left"])
            yield out.assign(key=pdf["key_"].astype(str).to_numpy())[["key", "value", "resolved", "attempts", "left"]]

    picked = df.select(F.col(key).alias("key_"), F.col(value).cast("string").alias("value_"))
    return picked.mapInPandas(run, "key string, value string, resolved boolean, attempts int, left string")
