"""Source files that are not valid in their language.

A file is cut into chunks at line ends or commas where a statement may begin.
Each chunk becomes a *lexer-state map*: for every state the lexer may be in when
the chunk starts, the state in which it ends and a bracket summary (closers that
need an opener to their left, openers left over). Neighbouring maps combine
associatively, within a row for most files, in rounds over groups of neighbours
in whatever partition for files of more than ``LONG_CHARS``.

The reduced map decides: a file that ends inside a string, closes what it never
opened, crosses or leaves brackets open is invalid, without a parser. Prefixes of
the reduction say at which chunk bounds the lexer is outside of strings and
brackets (of JSON: directly inside the outermost bracket); there the file falls
into balanced statements, and these are parsed one group after the other with
the grammar of the language. What binds statements together is checked beside
it: elements between commas are not blank, and keys and tables of TOML go
together, with values replaced by stand-ins. No file is parsed as a whole unless
it is one statement group.

Languages, by the ending of the path in either case: py, pyw, py3 (the Python of
the workers, 3.13 in this project), json (RFC 8259), jsonl (each non-blank line
is JSON) and toml (TOML 1.0).

Defined results: a null code or path and an unknown ending are never flagged
(there is nothing to parse, or no grammar); an empty or blank Python, TOML or
JSONL file is valid, an empty JSON file is not; a byte order mark at the start
is skipped in Python and TOML files and accepted in JSON; NaN and Infinity are
not JSON; repeated keys are valid JSON; Python nested deeper than its parser
allows is invalid, as for the parser itself. Repeated rows are judged each.
"""

from __future__ import annotations

import ast
import json
import re
import sys
import tomllib
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

CHUNK_CHARS = 256
LONG_CHARS = 1 << 20
GROUP = 64
LANGUAGES = {"py": "python", "pyw": "python", "py3": "python", "json": "json", "jsonl": "jsonl", "toml": "toml"}
CLOSER = {")": "(", "]": "[", "}": "{"}

#: Tokens that matter outside of strings and comments.
_PY_N = re.compile(r"#|(?:(?<!\w)([A-Za-z]{1,2}))?(\"\"\"|'''|\"|')|[()\[\]{}]")
_PY_FIELD = re.compile(r"#|(?:(?<!\w)([A-Za-z]{1,2}))?(\"\"\"|'''|\"|')|[()\[\]{}:]")
_TOML_N = re.compile(r"#|(\"\"\"|'''|\"|')|[()\[\]{}]")
_JS_N = re.compile(r"\"|[\[\]{}]")
QUOTES = ['"""', "'''", '"', "'"]
#: Tokens that matter in a comment, in each kind of string, and in the text of formatted strings.
_ENDS = {"C": re.compile(r"\n"), **{q: re.compile(r"\\.|" + q + ("|\n" if len(q) == 1 else ""), re.S) for q in QUOTES}}
_TOML_ENDS = {
    "C": _ENDS["C"], '"""': re.compile(r'\\.|"{3,5}', re.S), "'''": re.compile(r"'{3,5}"), '"': _ENDS['"'], "'": re.compile(r"'|\n"),
}
for _q in QUOTES:
    _end = _q + ("|\n" if len(_q) == 1 else "")
    _ENDS["f" + _q] = re.compile(r"\\N\{[^}\n]*\}|\\[^{}]|\{\{|\{|" + _end, re.S)
    _ENDS["F" + _q] = re.compile(r"\\[^{}]|\{\{|\{|" + _end, re.S)  # raw
    _ENDS["s" + _q] = re.compile(r"\\[^{}]|\{|\}|" + _q, re.S)  # a format specification
#: States: N normal, C comment, the open quote of a string, with f or F before it of a formatted one.
#: In the middle of a replacement field a map says "?"; the text is then read in order. X: never valid.
STATES = {
    "python": ["N", "C", *QUOTES, *[f + q for f in "fF" for q in QUOTES]], "toml": ["N", "C", *QUOTES], "json": ["N", '"'], "jsonl": ["N", '"'],
}
BROKEN = ("X", "", "")


def scan(language: str, text: str, state: str, fields: bool = False) -> tuple[str, str, str]:
    """(end state, closers wanting an opener, openers left over) of a chunk.

    An open replacement field is the state "?", or with ``fields`` an opener left over."""
    pos, need, stack = 0, [], []  # a replacement field lies on the stack as the state it returns to
    ends = _TOML_ENDS if language == "toml" else _ENDS
    normal = _JS_N if language in ("json", "jsonl") else _TOML_N if language == "toml" else _PY_N
    while True:
        if state == "N":
            in_field = bool(stack) and len(stack[-1]) > 1
            found = (_PY_FIELD if in_field else normal).search(text, pos)
            if not found:
                break
            token, pos = found.group(), found.end()
            if token == "#":
                state = "C"
            elif token in CLOSER:
                if in_field:
                    if token != "}":
                        return BROKEN
                    state = stack.pop()
                elif not stack:
                    need.append(token)
                elif stack.pop() != CLOSER[token]:
                    return BROKEN  # crossed brackets never balance
            elif token in "([{":
                stack.append(token)
            elif token == ":":
                state = "s" + stack[-1][1:]
            elif normal is _PY_N:
                prefix, quote = (found.group(1) or "").lower(), found.group(2)
                state = ("F" if "r" in prefix else "f") + quote if "f" in prefix else quote
            else:
                state = token
            continue
        found = ends[state].search(text, pos)
        if not found:
            break
        token, pos = found.group(), found.end()
        kind = state[0]
        if token[0] == "\\" or token == "{{" and kind != "s":
            continue
        if token == "{":
            stack.append(state)
            state = "N"
        elif token == "}":
            state = stack.pop()
        elif kind == "s":
            return BROKEN  # the string ends inside a replacement field
        elif token == "\n" and state != "C":
            return BROKEN  # a one-line string may not hold a line end
        else:
            state = "N"
    if any(len(x) > 1 for x in stack):
        if not fields:
            return "?", "", ""
        return "N", "".join(need), "{"
    return state, "".join(need), "".join(stack)


def combine(a: tuple[str, str, str], b: tuple[str, str, str]) -> tuple[str, str, str]:
    """Summary of two neighbouring chunks, given that b starts in a's end state."""
    for doubt in ("X", "?"):
        if a[0] == doubt or b[0] == doubt:
            return doubt, "", ""
    need, stack = a[1], list(a[2])
    for closer in b[1]:
        if not stack:
            need += closer
        elif stack.pop() != CLOSER[closer]:
            return BROKEN
    return b[0], need, "".join(stack) + b[2]


def combine_maps(a: dict, b: dict) -> dict:
    """The lexer-state map of two neighbouring chunks."""
    return {s: combine(m, b[m[0]] if m[0] in b else (m[0], "", "")) for s, m in a.items()}


def states_in(language: str, text: str) -> list[str]:
    """The states in which a chunk of the text may start: N, and strings that can reach over a line end or comma."""
    if language in ("json", "jsonl"):
        return STATES[language]
    quotes = [q for q in QUOTES if (q in text if len(q) == 3 else q + "" in text and "\\" in text)]
    return ["N", *[s for s in STATES[language] if s.lstrip("fF") in quotes]]


#: Where a chunk may begin: a line that can start a statement; in JSON, behind a comma.
_BOUNDS = {
    "python": re.compile(r"(?<=\n)(?!(?:else|elif|except|finally)\b)[^\W\d]|(?<=\n)@"), "toml": re.compile(r"(?<=\n)[\w\"'\[-]"),
    "json": re.compile(r"(?<=,)"), "jsonl": re.compile(r"(?<=\n)"),
}
_TOP_LINE = re.compile(r"(?:\A|\n)([^\s#)\]}])")


def chunk_bounds(language: str, text: str, size: int) -> list[int]:
    """Starts of the chunks of a text, each about ``size`` characters from the last."""
    bounds, at = [0], size
    while at < len(text):
        found = _BOUNDS[language].search(text, at)
        if not found or found.start() >= len(text):
            break
        bounds.append(found.start())
        at = found.start() + size
    return bounds


def chunk_map(language: str, chunk: str, states: list[str]) -> dict[str, tuple[str, str, str]]:
    return {s: scan(language, chunk, s) for s in states}


def prefixes(language: str, text: str, bounds: list[int]) -> list[tuple[str, str, str]]:
    """Reduced summaries from the start of the text to the end of each chunk."""
    states = states_in(language, text) if len(bounds) > 1 else ["N"]
    out: list[tuple[str, str, str]] = []
    total = {"N": ("N", "", "")}
    for i, (start, end) in enumerate(zip(bounds, [*bounds[1:], len(text)])):
        total = combine_maps(total, chunk_map(language, text[start:end], states if i else ["N"]))
        got = total["N"]
        if got[0] == "?":  # a bound inside a replacement field: read from the start, in order
            got = scan(language, text[:end], "N", fields=True)
        out.append(got)
    return out


def balanced(summary: tuple[str, str, str]) -> bool:
    return summary[0] in ("N", "C") and not summary[1] and not summary[2]


def _cuts(language: str, text: str, bounds: list[int], reduced: list[tuple[str, str, str]]) -> list[int]:
    """The bounds at which the text falls into balanced statements."""
    cuts = []
    for at, summary in zip(bounds[1:], reduced):
        if language == "json":
            if summary[0] == "N" and not summary[1] and len(summary[2]) == 1:
                cuts.append(at)
        elif balanced(summary) and not text[:at].rstrip("\r\n").endswith("\\"):
            last = list(_TOP_LINE.finditer(text, cuts[-1] if cuts else 0, at))
            if language != "python" or not (last and last[-1][1] == "@"):  # a decorator belongs to what follows
                cuts.append(at)
    return cuts


def _rfc(_: str):
    raise ValueError("not JSON")


def _json(text: str) -> None:
    json.loads(text, parse_constant=_rfc, parse_int=str, parse_float=str)


def _json_lines(text: str) -> None:
    for line in text.split("\n"):
        if line.strip(" \t\r"):
            _json(line)


def _python(text: str) -> None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        compile(text, "f", "exec", ast.PyCF_ONLY_AST)


GRAMMARS = {"python": _python, "json": _json, "jsonl": _json_lines, "toml": tomllib.loads}


def parses(language: str, text: str) -> bool:
    """Whether a text, a group of statements or a whole file, follows the grammar of the language."""
    if hasattr(sys, "set_int_max_str_digits"):
        sys.set_int_max_str_digits(0)
    try:
        GRAMMARS[language](text.removeprefix("\ufeff"))
    except (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError):
        return False
    return True


def _json_statements(text: str, cuts: list[int]) -> Iterator[str]:
    """The elements of the outermost bracket in groups, each in brackets of its own; a blank one is no JSON."""
    opener, closer = text.lstrip(" \t\r\n")[:1], text.rstrip(" \t\r\n")[-1:]
    first, last = text.index(opener) + 1, text.rindex(closer)
    for start, end in zip([first, *cuts], [*[c - 1 for c in cuts], last]):
        piece = text[start:end]
        yield opener + piece + closer if piece.strip(" \t\r\n") else ""


_TOML_KEY = re.compile(r"\s*(?:[\w-]+|\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*')(?:[ \t]*\.[ \t]*(?:[\w-]+|\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*'))*[ \t]*=[ \t]*")


def _toml_skeleton(text: str) -> str:
    """Headers and keys of a text whose statements are valid, with stand-ins for scalar values and arrays."""
    out, held = [], ""
    for line in text.split("\n"):
        held = held + "\n" + line if held else line
        if not balanced(scan("toml", held + "\n", "N")):
            continue
        key = _TOML_KEY.match(held)
        value = held[key.end():key.end() + 1] if key else ""
        out.append(held if not key or value == "{" else key.group() + ("[]" if value == "[" else "0"))
        held = ""
    return "\n".join([*out, held])


def valid(language: str, text: str, summary: tuple[str, str, str] | None = None, size: int = CHUNK_CHARS) -> bool:
    """The reduced map, then the grammar on balanced statement groups."""
    text = text.removeprefix("\ufeff")
    if summary is not None and summary[0] != "?" and not balanced(summary):
        return False
    bounds = chunk_bounds(language, text, size)
    reduced = prefixes(language, text, bounds)
    if not balanced(reduced[-1]):
        return False
    cuts = _cuts(language, text, bounds, reduced)
    if not cuts:
        return parses(language, text)
    if language == "json":
        return all(parses(language, piece) for piece in _json_statements(text, cuts))
    pieces = [text[start:end] for start, end in zip([0, *cuts], [*cuts, len(text)])]
    if language == "toml":  # a header of its own lets tables of other pieces alone
        return all(parses(language, piece) for piece in pieces) and parses(language, _toml_skeleton(text))
    return all(parses(language, piece) for piece in pieces)


def language_of(path: Column) -> Column:
    """The language named by the ending of a path, null for an unknown one."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    mapping = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return mapping[ending]


def _split(chunk_chars: int):
    """Chunks of long files, to be read wherever they are sent."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, language, code in zip(pdf["key_"], pdf["lang_"], pdf["code_"]):
                text = code.removeprefix("\ufeff")
                bounds = chunk_bounds(language, text, chunk_chars)
                states = json.dumps(states_in(language, text))
                rows += [(key, language, i, states, text[s:e]) for i, (s, e) in enumerate(zip(bounds, [*bounds[1:], len(text)]))]
            yield pd.DataFrame(rows, columns=["key_", "lang_", "seq_", "states_", "chunk_"])

    return run


def _chunk_maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        maps = [
            json.dumps(chunk_map(language, chunk, json.loads(states) if seq else ["N"]))
            for language, seq, states, chunk in zip(pdf["lang_"], pdf["seq_"], pdf["states_"], pdf["chunk_"])
        ]
        yield pdf[["key_", "seq_"]].assign(map_=maps)


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    total = None
    for text in pdf.sort_values("seq_")["map_"]:
        one = {s: tuple(m) for s, m in json.loads(text).items()}
        total = one if total is None else combine_maps(total, one)
    head = pdf.iloc[0]
    return pd.DataFrame({"key_": [head["key_"]], "seq_": [head["seq_"] // GROUP], "map_": [json.dumps(total)]})


MAP_SCHEMA = "key_ long, seq_ long, map_ string"
#: A value has at most 2^31 characters.
MOST_CHARS = 1 << 31


def bracket_summaries(files: DataFrame, chunk_chars: int = LONG_CHARS) -> DataFrame:
    """key_, map_: the reduced lexer-state map of each long file.

    ``files`` has key_, lang_, code_. Chunks are spread over all tasks; their maps
    meet in rounds of ``GROUP`` neighbours, so no task ever holds more than that
    many of one file.
    """
    chunks = files.select("key_", "lang_", "code_").mapInPandas(_split(chunk_chars), "key_ long, lang_ string, seq_ long, states_ string, chunk_ string")
    maps = chunks.repartition("key_", "seq_").mapInPandas(_chunk_maps, MAP_SCHEMA)
    most = MOST_CHARS // chunk_chars
    while most > 1:
        maps = maps.groupBy("key_", F.floor(F.col("seq_") / GROUP)).applyInPandas(_fold, MAP_SCHEMA)
        most //= GROUP
    return maps.select("key_", "map_")


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ok = [
            valid(language, code, tuple(json.loads(text)["N"]) if isinstance(text, str) else None)
            for language, code, text in zip(pdf["lang_"], pdf["code_"], pdf["map_"])
        ]
        yield pdf[["key_", "lang_", "group_"]].assign(valid_=ok)


def check_files(df: DataFrame, key: str, path: str, code: str, group: str, chunk_chars: int = LONG_CHARS) -> DataFrame:
    """key_, lang_, group_, valid_ of each file with a known language.

    The chunks of a file of up to ``chunk_chars`` are reduced and parsed in one
    map-only stage; those of a longer one go through the exchange of the reduction.
    ``key`` must be a unique long column.
    """
    files = df.select(
        F.col(key).cast("long").alias("key_"), language_of(F.col(path)).alias("lang_"), F.col(code).alias("code_"), F.col(group).cast("string").alias("group_")
    ).where(F.col("lang_").isNotNull() & F.col("code_").isNotNull())
    schema = "key_ long, lang_ string, group_ string, valid_ boolean"
    is_long = F.length("code_") > chunk_chars
    small = files.where(~is_long).withColumn("map_", F.lit(None).cast("string"))
    long = files.where(is_long)
    large = long.join(bracket_summaries(long, chunk_chars), "key_")
    return small.mapInPandas(_judge, schema).unionByName(large.mapInPandas(_judge, schema))


def rates(checked: DataFrame) -> DataFrame:
    """Files and invalid files per run and language."""
    return checked.groupBy(F.col("group_").alias("run_id"), F.col("lang_").alias("language")).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(~F.col("valid_")).alias("n_invalid"),
        F.bround(F.count_if(~F.col("valid_")) / F.count(F.lit(1)), 6).alias("rate"),
    )
