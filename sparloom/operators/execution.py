"""Running programs against tests, and comparing what they print.

Programs come from models and are not trusted. :func:`run_tests` therefore must
be asked for explicitly, starts one child process for each test with limits of
time, memory and file size, and is no sandbox: on a shared cluster run it in
containers without network.

A program is run as a whole (texts in, printed text out) or, where the tests
name a function, by calls of it with decoded arguments. A program that fails on
piped input is tried again with the input as a file, then with ``input.txt`` and
``output.txt``.
"""

from __future__ import annotations

import ast
import json
import math
import os
import secrets
import subprocess
import sys
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType


def _numbers(tokens: list[str]) -> list[float] | None:
    try:
        return [float(t) for t in tokens]
    except ValueError:
        return None


def same_output(got: str, expected: str) -> bool:
    """Whether two outputs agree: as stripped texts, line by stripped line, as
    numbers that are close, or as the same collection of lines in any order."""
    if got.strip() == expected.strip():
        return True
    a = [line.strip() for line in got.strip().split("\n") if line.strip()]
    b = [line.strip() for line in expected.strip().split("\n") if line.strip()]
    if a == b:
        return True
    if len(a) == len(b):
        x, y = _numbers(" ".join(a).split()), _numbers(" ".join(b).split())
        if x is not None and y is not None and len(x) == len(y):
            return all(math.isclose(p, q, rel_tol=1e-6, abs_tol=1e-9) for p, q in zip(x, y))
    return sorted(a) == sorted(b)


@F.pandas_udf(BooleanType())
def same_output_udf(got: pd.Series, expected: pd.Series) -> pd.Series:
    return pd.Series([same_output(g, e) if isinstance(g, str) and isinstance(e, str) else False for g, e in zip(got, expected)])


def _limits(memory_mb: int, seconds: float):
    def apply() -> None:
        import resource

        resource.setrlimit(resource.RLIMIT_AS, (memory_mb << 20, memory_mb << 20))
        resource.setrlimit(resource.RLIMIT_CPU, (math.ceil(seconds), math.ceil(seconds) + 1))
        resource.setrlimit(resource.RLIMIT_FSIZE, (1 << 20, 1 << 20))

    return apply


def _compiles(code: str) -> bool:
    try:
        compile(code, "program", "exec")
    except (SyntaxError, ValueError):
        return False
    return True


def _started(arguments: list[str], folder: str, seconds: float, memory_mb: int, **streams) -> subprocess.CompletedProcess:
    return subprocess.run(
        [sys.executable, "-I", *arguments], capture_output=True, text=True, timeout=seconds, cwd=folder,
        env={"PATH": "/usr/bin:/bin"}, preexec_fn=_limits(memory_mb, seconds), **streams,
    )


def run_one(code: str, given: str, expected: str, seconds: float = 4.0, memory_mb: int = 512) -> str:
    """Outcome of one program on one input: piped, else as a file, else as
    ``input.txt`` with the result in ``output.txt``."""
    if not _compiles(code):
        return "syntax_error"
    with tempfile.TemporaryDirectory() as folder:
        try:
            done = _started(["-c", code], folder, seconds, memory_mb, input=given)
            if done.returncode:
                with tempfile.TemporaryFile("w+") as file:
                    file.write(given)
                    file.seek(0)
                    done = _started(["-c", code], folder, seconds, memory_mb, stdin=file)
            if not done.returncode:
                return "passed" if same_output(done.stdout, expected) else "logical_error"
            source, target = os.path.join(folder, "input.txt"), os.path.join(folder, "output.txt")
            with open(source, "w") as file:
                file.write(given)
            if os.path.lexists(target):
                os.remove(target)
            done = _started(["-c", code], folder, seconds, memory_mb, stdin=subprocess.DEVNULL)
            if done.returncode or not os.path.isfile(target):
                return "runtime_error"
            with open(target, errors="replace") as file:
                return "passed" if same_output(file.read(), expected) else "logical_error"
        except subprocess.TimeoutExpired:
            return "timeout"
        except (OSError, ValueError):
            return "evaluator_error"


#: Runs in the child: program, function name, arguments and the mark of the result's line come as JSON on its input.
_CALLER = """
import json, sys
task = json.loads(sys.stdin.read())
def keyed(value):
    try:
        return {int(k): v for k, v in value.items()} if isinstance(value, dict) else value
    except ValueError:
        return value
def plain(value):
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    return value.item() if hasattr(value, "item") else value
space = {"__name__": "program"}
exec('''import sys, time, itertools, collections, functools, math, fractions, random, heapq, bisect, re
from collections import Counter, OrderedDict, deque, defaultdict, ChainMap
from functools import lru_cache, cache, reduce
from heapq import heappush, heappop, heapify
from itertools import accumulate, product, permutations, combinations
from math import sqrt, ceil, floor, gcd, log, log2
from typing import *''', space)
exec(compile(task["code"], "program", "exec"), space)
owner = space["Solution"]() if isinstance(space.get("Solution"), type) else None
function = getattr(owner, task["name"], None) or space[task["name"]]
result = plain(function(*map(keyed, task["arguments"])))
print()
print(task["mark"] + json.dumps(result, default=repr))
"""


def _lists(value):
    if isinstance(value, (list, tuple)):
        return [_lists(v) for v in value]
    return {str(k): _lists(v) for k, v in value.items()} if isinstance(value, dict) else value


def decoded(value):
    """A value of the tests: texts that are JSON or Python literals are read."""
    if not isinstance(value, str):
        return value
    try:
        return json.loads(value)
    except ValueError:
        pass
    try:
        read = _lists(ast.literal_eval(value.strip()))
        json.dumps(read)
        return read
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return value


def arguments_of(given) -> list:
    """Arguments of one call: a list as it is; of a text, a value from each
    line, or from each word of a single line of values."""
    if not isinstance(given, str):
        return given if isinstance(given, list) else [given]
    lines = [line for line in given.split("\n") if line.strip()]
    if len(lines) != 1:
        return [decoded(line) for line in lines]
    whole, words = decoded(lines[0]), [decoded(word) for word in lines[0].split()]
    return words if whole == lines[0] and not any(isinstance(w, str) for w in words) else [whole]


def same_value(got, expected) -> bool:
    """Whether two values agree, numbers closely; an expected list of one value also stands for the value."""
    def equal(a, b) -> bool:
        if isinstance(a, float) and isinstance(b, (int, float)) or isinstance(b, float) and isinstance(a, int):
            return a == b or math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9)
        if isinstance(a, list) and isinstance(b, list):
            return len(a) == len(b) and all(map(equal, a, b))
        if isinstance(a, dict) and isinstance(b, dict):
            return a.keys() == b.keys() and all(equal(a[k], b[k]) for k in a)
        return a == b

    return equal(got, expected) or isinstance(expected, list) and len(expected) == 1 and equal(got, expected[0])


def run_call(code: str, name: str, given, expected, seconds: float = 4.0, memory_mb: int = 512) -> str:
    """Outcome of one call of the function (or method of ``Solution``) ``name``."""
    if not _compiles(code):
        return "syntax_error"
    mark = secrets.token_hex(16)
    with tempfile.TemporaryDirectory() as folder:
        try:
            task = json.dumps({"code": code, "name": name, "arguments": arguments_of(given), "mark": mark})
            done = _started(["-c", _CALLER], folder, seconds, memory_mb, input=task)
        except subprocess.TimeoutExpired:
            return "timeout"
        except (OSError, ValueError):
            return "evaluator_error"
    last = next((line for line in reversed(done.stdout.split("\n")) if line.startswith(mark)), None)
    if done.returncode or last is None:
        return "runtime_error"
    try:
        got = json.loads(last[len(mark):])
    except ValueError:
        return "runtime_error"
    return "passed" if same_value(got, expected) or same_value(got, decoded(expected)) else "logical_error"


def _text(value) -> str:
    """A list of lines as one text."""
    return "\n".join(map(str, value)) if isinstance(value, list) else str(value)


def run_tests(df: DataFrame, allow_untrusted: bool = False, seconds: float = 4.0) -> DataFrame:
    """task_id, i, outcome for rows of task_id, code, tests (JSON with inputs and
    outputs) and, if the column is there, fn_name, which else is read from the
    tests: the function to call. Tests of a task stop at its first failure;
    inputs and outputs of different numbers are ``invalid_test_data``."""
    if not allow_untrusted:
        raise PermissionError("running model programs must be allowed explicitly (allow_untrusted=True)")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for task, code, tests, name in zip(pdf["task_id"], pdf["code"], pdf["tests"], pdf["fn_name"]):
                if not isinstance(code, str) or not code.strip():
                    rows.append((task, 0, "missing_code"))
                    continue
                try:
                    parsed = json.loads(tests)
                    name = parsed.get("fn_name") or name
                    pairs = list(zip(parsed["inputs"], parsed["outputs"], strict=True))
                except (TypeError, ValueError, KeyError, AttributeError):
                    rows.append((task, 0, "invalid_test_data"))
                    continue
                if not pairs:
                    rows.append((task, 0, "no_tests"))
                for i, (given, expected) in enumerate(pairs):
                    outcome = run_call(code, name, given, expected, seconds) if name else run_one(code, _text(given), _text(expected), seconds)
                    rows.append((task, i, outcome))
                    if outcome != "passed":
                        break
            yield pd.DataFrame(rows, columns=["task_id", "i", "outcome"])

    name = F.col("fn_name") if "fn_name" in df.columns else F.lit(None).cast("string")
    return df.select("task_id", "code", "tests", F.nullif(F.trim(name), F.lit("")).alias("fn_name")).mapInPandas(run, "task_id string, i int, outcome string")
