"""Personal information in free text, found by bootstrapped contextual extraction.

1. *Candidates.* A map-only stage cuts from every text what has the shape of an
   e-mail address, a number with at least six digits, a street with house number
   or two neighbouring capitalised words, each with its place and its context
   patterns: the two tokens to its left, and the token on either side. Candidates
   whose shape or whose agreement with an address nearby leaves no doubt are
   *seeds*. The rows are staged, so texts are scanned once for them.
2. *Pattern-instance graph.* Edges (pattern, instance) with the number of their
   documents are scored for some rounds. A pattern is as good as the share of its
   instances that are known, or the share of its documents, whichever is lower:
   what a text template repeats gains nothing from the many names beside it, and
   a constant such as a shard number counts once. An instance is as good as the
   best of its patterns; patterns cut from one context are no independent
   witnesses.
3. *Lexicon.* Parts of known names become given and family names, again by the
   lower of the shares over distinct instances and over documents. A pattern
   alone makes no name: one part must be in the lexicon, the other must not speak
   against it.
4. *Extraction.* Candidates are accepted as seeds or by patterns without reading
   the text again; a light second pass finds pairs of lexicon parts in any case.
   Overlaps go to the surer, then longer candidate. :func:`redact` puts
   ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` and ``[NAME]`` in
   their place.

The graph is aggregated over all texts. Patterns meet the staged candidates in a
join. The lexicon is sent to all tasks up to ``BROADCAST_ROWS`` parts; a longer
one is joined to the words of each document, with the same result.

Defined results: null, empty and blank texts hold nothing; positions count code
points; a repeated row is a row of its own and gives the same spans; an empty
table gives no rows. Texts of any length are processed whole. The key is unique.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

KINDS = ["email", "phone", "id_number", "address", "name"]
ROUNDS = 3
GOOD_PATTERN = 0.6
GOOD_PART = 0.55
POSSIBLE_PART = 0.5
BROADCAST_ROWS = 200_000

_AT = r"(?:\s?[@＠]\s?|\s?[\[({<]\s?(?:at|arroba)\s?[\])}>]\s?|\s(?:at|AT|arroba)\s)"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|punkt|point|punto)\s?[\])}>]\s?|\s(?:dot|DOT|punkt|point|punto)\s)"
_LOCAL = rf"[\w](?:[\w.+%-]*[\w])?(?:(?:\s?[\[({{<]\s?dot\s?[\])}}>]\s?|\sDOT\s)[\w+%-]+)*"
#: An address is found at its at sign; its local part is read backwards from there.
_AT_DOMAIN = re.compile(rf"(?:[@＠]|{_AT})[\w-]+(?:{_DOT}[\w-]+)+", re.I)
_LOCAL_END = re.compile(rf"(?<![\w.+-]){_LOCAL}$", re.I)
LOCAL_CHARS = 120
#: One of these is in every text with an address.
_AT_SIGNS = ("@", "＠", "at)", "at]", "at}", "at>", "at )", "at ]", "arroba", "dot", "punkt", "punto", " point ")
_EXT = r"(?:[ ,]{1,2}(?:ext\.?|extension|x|App\.|Durchwahl|Dw\.|poste|int\.)\s?\d{1,6})?"
NUMBER = re.compile(rf"(?<![\w@.#+/:-])(?:\(\+?|\+)?\d(?:[\d.\-/()]|[  ](?=[\d(]))*\d{_EXT}(?![\w@])(?!\.\d)", re.I)
_LABELS = r"(?!(?:SSN|DNI|NIE|NIF|NIR|CNI|ID|IBAN|BSN|SVN|RUN)\b)"
CODE = re.compile(
    rf"(?<![\w.@+/-])(?:{_LABELS}[A-Z]{{2}}(?: \d\d){{3}} [A-Z]|\d\d \d{{6}} [A-Z] \d{{3}}|[A-Z]-\d{{6,9}}-[A-Z]|"
    rf"\d{{1,2}}\.\d{{3}}\.\d{{3}}-?[A-Z]|\d{{7,9}}-?[A-Z]|{_LABELS}[A-Z]{{1,3}}\d[\dA-Z]{{5,11}})(?![\w-])"
)
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_EN_TYPE = (
    r"(?:Street|St\.|Road|Rd\.|Lane|Ln\.|Avenue|Ave|Close|Court|Ct\.|Drive|Dr\.|Way|Place|Square|Terrace|Crescent|Boulevard|Blvd|Row|Gardens|Mews|Grove)"
)
_UNIT = r"(?:,? (?:Flat|Apt\.?|Apartment|Unit|Suite) \w{1,4}\b|,? ?#\s?\d{1,5}\b)?"
#: For each language: words of which one occurs in every address, and its pattern.
ADDRESSES = [
    (("Street", "St.", "Road", "Rd.", "Lane", "Ln.", "Avenue", "Ave", "Close", "Court", "Ct.", "Drive", "Dr.", "Way", "Place", "Square", "Terrace", "Crescent", "Boulevard", "Blvd", "Row", "Gardens", "Mews", "Grove"),
     re.compile(rf"(?<![\w-])\d{{1,4}}[A-Za-z]? (?:{_CAP} ){{1,3}}{_EN_TYPE}(?!\w){_UNIT}")),
    (("stra", "Stra", "str.", "weg", "Weg", "gasse", "Gasse", "platz", "Platz", "allee", "Allee", "ufer", "damm", "ring", "steig"),
     re.compile(rf"(?<![\w-])(?:[A-ZÄÖÜ][\w-]*(?:stra(?:ß|ss)e|str\.|weg|gasse|platz|allee|ufer|damm|ring|steig)|{_CAP} (?:Straße|Weg|Gasse|Platz|Allee)) \d{{1,4}}(?: ?[a-z])?(?!\w)")),
    (("rue ", "avenue ", "av. ", "llée ", "llee ", "impasse ", "chemin ", "boulevard ", "bd ", "place ", "quai ", "passage ", "cours ", "square "),
     re.compile(rf"(?<![\w-])\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|av\.|all[ée]e|impasse|chemin|boulevard|bd|place|quai|passage|cours|square) (?:de la |de l['’]|des |du |de |d['’])?{_CAP}(?:, (?:apt|appt|appartement|bât)\.? \w{{1,4}}\b)?")),
    (("Calle", "C/", "Plaza", "Pl.", "Avda", "Avenida", "Av.", "Paseo", "Camino", "Ronda", "Travesía"),
     re.compile(rf"(?<![\w-])(?:Calle|C/|Plaza|Pl\.|Avda\.?|Avenida|Av\.|Paseo|Camino|Ronda|Travesía) (?:de los |de las |de la |del |de )?{_CAP},? \d{{1,4}}(?:, \d{{1,2}}\.?º(?: ?[A-Z]\b)?)?")),
]
#: Words that name an identity number.
ID_LABEL = re.compile(
    r"(?:\bssn|social\s+security|national\s+id|\bpassport|\bidentity\s+(?:card|no|number)|\btax\s+id|\bsteuer|\bsozialvers|\bsv-n|\bausweis|\breisepass|"
    r"\bdni\b|\bnie\b|\bnif\b|\bnir\b|s[ée]curit[ée]\s+sociale|carte\s+d['’]identit[ée]|\bpasaporte|\bpasseport|seguridad\s+social|\bpersonalausweis)[^\d\n.;]{0,24}(?:n[or]\.|n\.\s?[ºo])?[^\d.;]{0,4}$",
    re.I,
)
WEAK_ADDRESS = re.compile(rf"(?<![\w-])\d{{1,4}}[A-Z]? {_CAP} {_CAP}(?!\w){_UNIT}")
#: Courtesy titles and particles of family names.
TITLES = {"dr", "prof", "mr", "mrs", "ms", "miss", "sir", "herr", "frau", "don", "doña", "sr", "sra", "srta", "mme", "mlle", "monsieur", "madame"}
PARTICLES = {"van", "der", "den", "von", "de", "la", "del", "du", "di", "da", "le", "ten", "ter", "dos", "zu"}
_TOKEN = re.compile(r"[^\W\d_](?:[\w'’]|-(?=\w))*|\d+|\n|[^\w\s]")
_SEP = r"[ \t\u00a0\u202f]*\n?[ \t\u00a0\u202f]*"
_CAPITALISED = re.compile(r"(?<![\w@.+/-])[^\W\d_a-zß-öø-ÿ](?:[^\W\d_]|['’-](?=[^\W\d_]))+(?![\w@/])")
_WORD = re.compile(r"(?<![\w@.+/-])[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))+(?![\w@/])")
#: What may lie between given and family name: blanks and one line end, initials, particles; or a comma.
_BETWEEN = re.compile(rf"(?=[\s,])(?:,{_SEP}|{_SEP}(?:(?:[^\W\d_]\.|{'|'.join(sorted(PARTICLES))})(?=\s){_SEP})*)", re.I)
_INITIAL_AFTER = re.compile(r"[ \u00a0][^\W\d_]\.(?!\w)")
_PARTICLES_BEFORE = re.compile(r"(?<!\w)(?:(?:van|von|der|den)\s)+$|(?<!\w)de\sla\s$", re.I)


def context(text: str, start: int, end: int) -> tuple[str, str]:
    """The two patterns of a span: two tokens to the left; one on either side."""
    left = _TOKEN.findall(text[max(0, start - 60):start])[-2:]
    right = _TOKEN.findall(text[end:end + 30])[:1]
    norm = [t.casefold() if not t.isdigit() else "9" for t in left]
    after = right[0].casefold() if right and not right[0].isdigit() else "9" if right else "$"
    while len(norm) < 2:
        norm.insert(0, "^")
    return " ".join(norm) + " _", f"{norm[1]} _ {after}"


def number_seed(value: str) -> str | None:
    """phone or id_number where the shape of a number leaves no doubt."""
    digits = re.sub(r"\D", "", value)
    if re.match(r"\(?\+|00[1-9]\d", value) and 9 <= len(digits) <= 18:
        return "phone"
    if re.search(r"\)", value) and 9 <= len(digits) <= 18:
        return "phone"
    if re.search(r"[a-z]\.?\s?\d+$", value, re.I):
        return "phone"
    if re.fullmatch(r"(?:1[-.])?\d{3}([-.])\d{3}\1\d{4}", value):
        return "phone"
    return None


def labelled(text: str, start: int) -> bool:
    """Whether the words just before a span name an identity number."""
    return ID_LABEL.search(text[max(0, start - 60):start]) is not None


def _case(word: str) -> str:
    return "l" if word.islower() else "u" if word.isupper() and len(word) > 1 else "t" if word[0].isupper() else "x"


def name_windows(text: str, words: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, given, family) of words of the list that follow each other as
    ``G F``, ``G X. F``, ``G van der F`` or ``F, G X.``."""
    for (start, end, first), (s, e, second) in zip(words, words[1:]):
        if s - end > 40:
            continue
        gap = text[end:s]
        if not _BETWEEN.fullmatch(gap):
            continue
        one, two = _case(first), _case(second)
        if one != two and not (one in "tu" and two in "tu"):
            continue
        if gap[0] == ",":
            tail = _INITIAL_AFTER.match(text, e)
            before = _PARTICLES_BEFORE.search(text, max(0, start - 24), start)
            yield before.start() if before else start, tail.end() if tail else e, second.casefold(), first.casefold()
        else:
            yield start, e, first.casefold(), second.casefold()


def capitalised(text: str) -> list[tuple[int, int, str]]:
    """Capitalised words that are no title and no particle."""
    return [
        (*m.span(), w) for m in _CAPITALISED.finditer(text)
        if (low := (w := m.group()).casefold()) not in TITLES and low not in PARTICLES and w[0].isupper()
    ]


def name_seed(given: str, family: str, locals_: list[str]) -> bool:
    """Whether a mail address near by is made of the two names."""
    g, f = re.sub(r"\W", "", given), re.sub(r"\W", "", family)
    if len(g) < 3 or len(f) < 3:
        return False
    for local in locals_:
        flat = re.sub(r"[^a-zà-ÿ]", "", local)
        if flat == g + f or flat == g[0] + f or flat == f + g or (flat == f and local[-1:].isdigit()) or (flat == g + f[:4] and len(f) > 4) or re.fullmatch(re.escape(g) + r"[-_.]" + re.escape(f[0]), local):
            return True
    return False


def scan(text: str) -> list[tuple[str, int, int, str, str, str, str | None, str, str]]:
    """(class, start, end, instance, pattern, pattern, seed, given, family) of a text."""
    out = []
    mails = []
    low = text.lower()
    for m in _AT_DOMAIN.finditer(text) if any(sign in low for sign in _AT_SIGNS) else ():
        from_ = max(mails[-1][1] if mails else 0, m.start() - LOCAL_CHARS)
        local = _LOCAL_END.search(text[from_:m.start()])
        if local:
            mails.append((from_ + local.start(), m.end(), text[from_ + local.start():m.end()]))
    for start, end, value in mails:
        out.append(("mail", start, end, value.casefold(), *context(text, start, end), "email", "", ""))
    taken = [(s, e) for s, e, _ in mails]
    for needed, pattern in ADDRESSES:
        if any(word in text for word in needed):
            for m in pattern.finditer(text):
                if not any(s < m.end() and m.start() < e for s, e in taken):
                    taken.append(m.span())
                    out.append(("place", *m.span(), m.group().casefold(), *context(text, *m.span()), "address", "", ""))
    for m in WEAK_ADDRESS.finditer(text):
        if not any(s < m.end() and m.start() < e for s, e in taken):
            out.append(("place", *m.span(), m.group().casefold(), *context(text, *m.span()), None, "", ""))
    for m in CODE.finditer(text):
        if sum(c.isdigit() for c in m.group()) >= 6 and not any(s < m.end() and m.start() < e for s, e in taken):
            taken.append(m.span())
            out.append(("number", *m.span(), re.sub(r"\W", "", m.group()).casefold(), *context(text, *m.span()), "id_number", "", ""))
    for m in NUMBER.finditer(text):
        digits = sum(c.isdigit() for c in m.group())
        if 9 <= digits <= 18 and not any(s < m.end() and m.start() < e for s, e in taken):
            seed = "id_number" if labelled(text, m.start()) else number_seed(m.group())
            out.append(("number", *m.span(), re.sub(r"\D", "", m.group()), *context(text, *m.span()), seed, "", ""))
    locals_ = [re.split(r"[@＠\s\[({<]", v, maxsplit=1)[0].casefold() for _, _, v in mails]
    for start, end, given, family in name_windows(text, capitalised(text)):
        seed = "name" if mails and name_seed(given, family, locals_) else None
        out.append(("person", start, end, f"{given} {family}", *context(text, start, end), seed, given, family))
    return out


CANDIDATE_COLUMNS = ["key_", "class", "start_at", "end_at", "instance", "pattern_a", "pattern_b", "seed", "sure", "given", "family", "docs"]
CANDIDATE_SCHEMA = (
    "key_ long, class string, start_at long, end_at long, instance string, pattern_a string, pattern_b string, seed string, sure double, "
    "given string, family string, docs long"
)


def certainty(text: str, cls: str, start: int, seed: str | None) -> float | None:
    """Rank of a candidate that needs no pattern, null for the others."""
    if seed and cls in ("mail", "place"):
        return 3.0
    if cls == "number" and (seed == "phone" or seed and labelled(text, start)):
        return 2.5
    return None


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, text in zip(pdf["key_"], pdf["text_"]):
            if isinstance(text, str):
                seen: set[tuple[str, ...]] = set()
                for cls, start, end, instance, a, b, seed, given, family in scan(text):
                    edge = (cls, instance, a, b, given, family)
                    rows.append((key, cls, start, end, instance, a, b, seed, certainty(text, cls, start, seed), given, family, int(edge not in seen)))
                    seen.add(edge)
        yield pd.DataFrame(rows, columns=CANDIDATE_COLUMNS)


def candidates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every candidate with its place, contexts and seed; ``docs`` is 1 for the first of its kind in a text."""
    return df.select(F.col(key).cast("long").alias("key_"), F.col(text).alias("text_")).mapInPandas(_candidates, CANDIDATE_SCHEMA)


def edges(found: DataFrame) -> DataFrame:
    """Edges of the pattern-instance graph with the number of their documents."""
    return (
        found.groupBy("class", "instance", "given", "family", "pattern_a", "pattern_b").agg(F.max("seed").alias("seed"), F.sum("docs").alias("docs"))
        .withColumn("pattern", F.explode(F.array("pattern_a", "pattern_b")))
        .groupBy("class", "instance", "given", "family", "pattern").agg(F.max("seed").alias("seed"), F.sum("docs").alias("docs"))
    )


def score(graph: DataFrame, stage: Callable[[DataFrame, str], DataFrame], rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(patterns, instances) with their score for each label.

    A label's known mass of an instance is 1 for a seed, else the score of its
    best pattern, among those with at least three instances and a score of 0.3.
    A pattern's score is the known mass of its instances over their number plus
    one, or the same with each instance counted as often as it has documents in
    this pattern, whichever is lower.
    """
    nodes = ["class", "instance"]
    known = (
        graph.groupBy(*nodes).agg(F.max("seed").alias("seed")).where(F.col("seed").isNotNull())
        .select(*nodes, F.col("seed").alias("label"), F.lit(1.0).alias("mass"))
    )
    support = stage(graph.groupBy("class", "pattern").agg(F.count(F.lit(1)).alias("n"), F.sum("docs").alias("n_docs")), "support")
    seeds = known
    for i in range(rounds):
        patterns = (
            graph.join(known, nodes).groupBy("class", "pattern", "label")
            .agg(F.sum("mass").alias("mass"), F.sum(F.col("mass") * F.col("docs")).alias("mass_docs"))
            .join(support, ["class", "pattern"])
            .select("class", "pattern", "label", "n", F.least(F.col("mass") / (F.col("n") + 1), F.col("mass_docs") / (F.col("n_docs") + 1)).alias("score"))
            .where("n >= 3 and score >= 0.3")
        )
        patterns = stage(patterns, f"patterns{i}")
        if i + 1 < rounds:
            inferred = graph.join(patterns, ["class", "pattern"]).groupBy(*nodes, "label").agg(F.max("score").alias("mass"))
            known = stage(inferred.unionByName(seeds).groupBy(*nodes, "label").agg(F.max("mass").alias("mass")), f"known{i}")
    return patterns, known


def lexicon(graph: DataFrame, known: DataFrame) -> DataFrame:
    """part, role, kept: given and family names.

    The share of a part in a role is the known mass over the instances that hold
    it there, or over their documents, whichever is lower. It is kept from
    GOOD_PART on if it is known with two partners or in a seed; the others from
    POSSIBLE_PART on may stand beside a kept one.
    """
    people = graph.where("class = 'person'").groupBy("instance", "given", "family").agg(F.max("seed").alias("seed"), F.sum("docs").alias("docs"))
    mass = known.where("label = 'name'").select("instance", "mass")
    scored = people.join(mass, "instance", "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))
    roles = scored.select(
        F.explode(F.array(
            F.struct(F.col("given").alias("part"), F.lit("given").alias("role")),
            F.struct(F.col("family").alias("part"), F.lit("family").alias("role")),
        )).alias("r"), "mass", "seed", "docs",
    ).groupBy("r.part", "r.role").agg(
        F.sum("mass").alias("mass"), F.count(F.lit(1)).alias("n"), F.sum(F.col("mass") * F.col("docs")).alias("mass_docs"), F.sum("docs").alias("n_docs"),
        F.count_if(F.col("mass") >= 0.7).alias("sure"), F.count("seed").alias("seeds"),
    )
    share = F.least(F.col("mass") / F.col("n"), F.col("mass_docs") / F.col("n_docs"))
    return roles.where(share >= POSSIBLE_PART).select(
        "part", "role", ((share >= GOOD_PART) & ((F.col("sure") >= 2) | (F.col("seeds") >= 1))).alias("kept")
    )


SPAN_SCHEMA = "doc_id long, kind string, start_at long, end_at long"
FOUND_SCHEMA = "key_ long, start_at long, end_at long, rank double, kind string"


def resolve(found: list[tuple[float, int, int, str]]) -> list[tuple[str, int, int]]:
    """The spans that stay where spans overlap: surer first, then longer, then earlier."""
    kept: list[tuple[int, int, str]] = []
    for _, start, end, kind in sorted(found, key=lambda x: (-x[0], x[1] - x[2], x[1], x[3])):
        if all(end <= s or e <= start for s, e, _ in kept):
            kept.append((start, end, kind))
    return [(kind, s, e) for s, e, kind in sorted(kept)]


class Names:
    """Given and family names; a hyphenated family name of known parts is one."""

    def __init__(self, given: set[str], family: set[str]):
        self.given, self.family = given, family
        self.cores = [{self._core(p) for p in side} for side in (given, family)]

    @staticmethod
    def _core(part: str) -> str:
        return max(_PIECES.findall(part), key=len, default="")

    def is_family(self, part: str) -> bool:
        return part in self.family or ("-" in part and all(p in self.family for p in part.split("-")))

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Pairs of a given and a family name in any case."""
        pieces = set(_PIECES.findall(text.casefold()))
        if any(pieces.isdisjoint(core) for core in self.cores):
            return []
        words = [(*m.span(), w) for m in _WORD.finditer(text) if (low := (w := m.group()).casefold()) in self.given or self.is_family(low)]
        return [
            (start, end) for start, end, g, f in name_windows(text, words)
            if g in self.given and self.is_family(f) or f in self.given and self.is_family(g)
        ]


_PIECES = re.compile(r"[^\W\d_]+")


def _pairs_shared(model) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Lexicon pairs of every text, with a lexicon that all tasks hold."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Names(*model.value)
        for pdf in batches:
            rows = [(key, s, e, 1.5, "name") for key, text in zip(pdf["key_"], pdf["text_"]) if isinstance(text, str) for s, e in names.spans(text)]
            yield pd.DataFrame(rows, columns=["key_", "start_at", "end_at", "rank", "kind"])

    return run


def _words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every distinct word of a text, and of a hyphenated one its pieces."""
    for pdf in batches:
        rows = []
        for key, text in zip(pdf["key_"], pdf["text_"]):
            if isinstance(text, str):
                words = {m.group().casefold() for m in _WORD.finditer(text)}
                rows += [(key, w) for w in words | {p for w in words if "-" in w for p in w.split("-")}]
        yield pd.DataFrame(rows, columns=["key_", "part"])


def _pairs_joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lexicon pairs of every text, each with the parts that occur in it."""
    for pdf in batches:
        rows = []
        for key, text, given, family in zip(pdf["key_"], pdf["text_"], pdf["given"], pdf["family"]):
            rows += [(key, s, e, 1.5, "name") for s, e in Names(set(given), set(family)).spans(text)]
        yield pd.DataFrame(rows, columns=["key_", "start_at", "end_at", "rank", "kind"])


def lexicon_pairs(texts: DataFrame, names: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Spans of lexicon pairs in ``texts`` (key_, text_); ``names`` has part and role."""
    held = names.limit(broadcast_rows + 1).collect()
    if len(held) <= broadcast_rows:
        sides = tuple({r["part"] for r in held if r["role"] == role} for role in ("given", "family"))
        return texts.mapInPandas(_pairs_shared(texts.sparkSession.sparkContext.broadcast(sides)), FOUND_SCHEMA)
    of_text = (
        texts.mapInPandas(_words_of, "key_ long, part string").join(names, "part").groupBy("key_")
        .agg(*(F.array_agg(F.when(F.col("role") == role, F.col("part"))).alias(role) for role in ("given", "family")))
        .where((F.size("given") > 0) & (F.size("family") > 0))
    )
    return texts.join(of_text, "key_").mapInPandas(_pairs_joined, FOUND_SCHEMA)


def accepted(found: DataFrame, patterns: DataFrame, parts: DataFrame) -> DataFrame:
    """Candidates that a seed or a pattern accepts, with their rank."""
    best = (
        patterns.where(F.col("score") >= GOOD_PATTERN).groupBy("class", "pattern")
        .agg(F.max(F.struct("score", "label")).alias("best"))
    )
    span = ["key_", "start_at", "end_at"]
    certain = found.where("sure is not null").select(*span, F.col("sure").alias("rank"), F.col("seed").alias("kind"))
    open_ = found.where("sure is null")

    def beside(name: str) -> DataFrame:
        return best.select("class", F.col("pattern").alias(f"pattern_{name}"), F.col("best").alias(f"best_{name}"))

    met = (
        open_.join(beside("a"), ["class", "pattern_a"], "left").join(beside("b"), ["class", "pattern_b"], "left")
        .withColumn("best", F.greatest("best_a", "best_b")).where(F.col("best").isNotNull() | (F.col("seed") == "name"))
    )
    value = met.where("class <> 'person'").select(*span, (2 + F.col("best.score") / 10).alias("rank"), F.col("best.label").alias("kind"))

    def role(name: str) -> DataFrame:
        return parts.where(F.col("role") == name).select(F.col("part").alias(name), F.col("kept").alias(f"{name}_kept"))

    person = (
        met.where("class = 'person'").join(role("given"), "given").join(role("family"), "family").where("given_kept or family_kept")
        .select(*span, (1 + F.coalesce("best.score", F.lit(GOOD_PATTERN)) / 10).alias("rank"), F.lit("name").alias("kind"))
    )
    return certain.unionByName(value).unionByName(person)


def _resolved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [
            (key, kind, start, end) for key, spans in zip(pdf["key_"], pdf["spans_"])
            for kind, start, end in resolve([(s["rank"], s["start_at"], s["end_at"], s["kind"]) for s in spans])
        ]
        yield pd.DataFrame(rows, columns=["doc_id", "kind", "start_at", "end_at"])


def find(df: DataFrame, stage: Callable[[DataFrame, str], DataFrame], key: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, kind, start_at, end_at of every occurrence in every row."""
    found = stage(candidates(df, key, text), "candidates")
    graph = stage(edges(found), "edges")
    patterns, known = score(graph, stage)
    parts = stage(lexicon(graph, known), "lexicon")
    texts = df.select(F.col(key).cast("long").alias("key_"), F.col(text).alias("text_")).where(F.col("text_").isNotNull())
    pairs = lexicon_pairs(texts, parts.where("kept").select("part", "role"), broadcast_rows)
    spans = accepted(found, patterns, parts).unionByName(pairs)
    per_text = spans.groupBy("key_").agg(F.collect_list(F.struct("rank", "start_at", "end_at", "kind")).alias("spans_"))
    return per_text.mapInPandas(_resolved, SPAN_SCHEMA)


def replace_spans(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with ``[KIND]`` in place of each span."""
    out, at = [], 0
    for kind, start, end in found:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def redact(df: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, redacted) of every row; spans of one row are gathered, texts are joined once."""
    per_row = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_at", "end_at", "kind"))).alias("spans_"))
    joined = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text_")).join(per_row, "doc_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            redacted = [
                replace_spans(t, [(s["kind"], s["start_at"], s["end_at"]) for s in sp]) if isinstance(t, str) and sp is not None else t
                for t, sp in zip(pdf["text_"], pdf["spans_"])
            ]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "redacted": redacted})

    return joined.mapInPandas(run, "doc_id long, redacted string")
