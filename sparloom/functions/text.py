"""Text expressions. All of them are native column expressions unless the name
ends in ``_udf``; a null input gives null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_EDGE = r"(?U)^\s+|\s+$"
#: The fences a code answer may carry.
PYTHON_FENCE = r"(?is)```(?:python3|python|py)[ \t]*\r?\n(.*?)```"
ANY_FENCE = r"(?is)```[a-z0-9_+-]*[ \t]*\r?\n(.*?)```"
#: Difficulty names and their aliases.
DIFFICULTIES = ["EASY", "MEDIUM", "MEDIUM_HARD", "HARD", "VERY_HARD"]
DIFFICULTY_ALIASES = {"MEDIUMHARD": "MEDIUM_HARD", "VERYHARD": "VERY_HARD"}
#: Repair strategies, used in turn.
STRATEGIES = ["direct", "minimal_edit", "restate", "split_clauses", "rebuild_section"]


def strip(text: Column) -> Column:
    """Without Unicode white space on both ends."""
    return F.regexp_replace(text, _EDGE, "")


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def normalize_prompt(text: Column) -> Column:
    """Zero-width space and byte order mark dropped, other blanks made plain; tabs and line ends stay."""
    return F.regexp_replace(F.regexp_replace(text, "[\\x{200B}\\x{FEFF}]", ""), r"\p{Zs}", " ")


def normalize_difficulty(text: Column) -> Column:
    """Upper case with underscores; the spellings without one are aliases."""
    plain = F.translate(F.upper(strip(text)), "- ", "__")
    out = plain
    for alias, name in DIFFICULTY_ALIASES.items():
        out = F.when(plain == alias, name).otherwise(out)
    return out


def safe_name(text: Column) -> Column:
    """A file name: runs of other signs become one underscore, ``task`` if nothing is left."""
    trimmed = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_.\-]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(trimmed, F.lit("")), F.lit("task"))


def collapse(text: Column) -> Column:
    """Lower case with runs of white space made one blank. (``lower`` keeps the
    sharp s, where a case fold would write ss.)"""
    return F.lower(F.regexp_replace(strip(text), r"(?U)\s+", " "))


def first_fence(text: Column) -> Column:
    """The first fenced block, else the text without ``[PYTHON]`` tags."""
    block = F.regexp_extract(text, ANY_FENCE, 1)
    has = F.regexp_like(text, F.lit(ANY_FENCE))
    return strip(F.when(has, block).otherwise(F.regexp_replace(text, r"(?i)\[/?PYTHON\]", "")))


def _longest(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))


def longest_fence(text: Column) -> Column:
    """The longest Python block, else the longest block of any language, else the
    text without fences and tags; of equally long ones the first."""
    plain = F.regexp_replace(text, r"(?i)\[/?PYTHON\]|</?python>", "")
    python = F.regexp_extract_all(plain, F.lit(PYTHON_FENCE), F.lit(1))
    anything = F.regexp_extract_all(plain, F.lit(ANY_FENCE), F.lit(1))
    bare = F.regexp_replace(plain, r"```[A-Za-z0-9_+-]*", "")
    return strip(F.when(F.size(python) > 0, _longest(python)).when(F.size(anything) > 0, _longest(anything)).otherwise(bare))


def unwrap_fence(text: Column) -> Column:
    """The inside of a text that is one fenced block as a whole, else the text itself."""
    whole = r"(?is)^\s*```[a-z0-9_+-]*[ \t]*\r?\n((?:(?!```).)*)```\s*$"
    return F.when(F.regexp_like(text, F.lit(whole)), strip(F.regexp_extract(text, whole, 1))).otherwise(text)


def after_reasoning(text: Column) -> Column:
    """What follows a think block; an unclosed block leaves nothing."""
    return (
        F.when(F.contains(text, F.lit("</think>")), strip(F.substring_index(text, "</think>", -1)))
        .when(F.contains(text, F.lit("<think>")), F.lit(""))
        .otherwise(strip(text))
    )


def escape_repaired(text: Column) -> Column:
    """Backslashes that start no JSON escape are doubled."""
    return F.regexp_replace(text, r'\\(?!["\\/bfnrtu])', r"\\\\")


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def strategy(attempt: Column) -> Column:
    """Strategy of the attempt-th try, counted from 1."""
    return F.element_at(F.array(*map(F.lit, STRATEGIES)), ((attempt - 1) % len(STRATEGIES) + 1).cast("int"))


def prompt(*parts: Column) -> Column:
    """Parts joined by line ends, nulls left out."""
    return F.concat_ws("\n", *parts)


def generic_instruction(text: Column) -> Column:
    """Whether an instruction only says to fix, correct or change this or that."""
    return F.regexp_like(strip(text), F.lit(r"(?i)^(?:fix|correct|repair|clarify|align|replace|add|remove)(?: this| the)?(?: clause| issue| requirement| expression| description)?[.!]?$"))


def same_text(a: Column, b: Column) -> Column:
    """Whether two texts are equal without white space at their ends."""
    return F.coalesce(strip(a) == strip(b), F.lit(False))
