"""Secret scan: three fixed patterns, and guess costs of values in a credential's context.

The patterns give the base spans. The method adds spans of kind `guess`: a value that follows a credential word
and a sign of assignment is cut, by dynamic programming, into the segments that are cheapest to guess (words by their
rank, dates, repeats, keyboard walks, references such as `${NAME}`, names such as `process.env.NAME` by their parts,
addresses of web pages up to their query, brute force for the rest); if even the cheapest cut takes 10**LIMIT guesses or more, and no base span covers the value,
it is reported. Words are ranked by the number of documents that hold them, counted over the whole table (`ranked_words`);
words that guessers try first come before them.

Defined results: null text counts as empty (no spans, the digest of the empty string); positions are code points,
ends exclusive; whole texts are read, whatever their length; repeated rows give repeated results; ties between cuts go
to the one found first, and words of equal counts to the smaller one; an empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices, table, texts_of

LIMIT = 10.0
KINDS = ("assign", "access", "hex", "guess")

# The patterns of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")

# A value in quotes goes to its own closing quote, another one to white space; no value holds white space.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|auth)[_-]?key|auth(?:orization)?|credentials?|bearer)["']?(?:\s{0,8}(?:[:=]|:=|=>)\s{0,8}|\s{1,8}(?=["']))(?:bearer\s{1,8})?(?:"([^"\s]{6,})"|'([^'\s]{6,})'|`([^`\s]{6,})`|["']?([^\s"'`]{6,}))""", re.IGNORECASE | re.ASCII)
STEMS = ("pass", "pwd", "secret", "token", "key", "auth", "cred", "bearer")

# Words that guessers try first, in their order.
COMMON = (
    "password pass admin welcome login letmein monkey dragon master hello freedom whatever shadow sunshine princess football "
    "baseball secret love god user test guest root change changeme default example sample dummy token key access value "
    "string null none true false your my the here placeholder insert replace enter todo fixme temp demo dev prod public "
    "private server client system database oracle mysql spring summer autumn winter monday friday january july home work "
    "qwerty abc xyz foo bar baz computer internet service account company office mail email name word phone super star "
    "blue green black white red orange apple banana cheese coffee summer flower tiger eagle lion wolf king queen jordan "
    "michael robert daniel thomas andrew joshua jennifer jessica charlie hunter killer trust magic money soccer hockey"
).split()
RANKS = {w: i + 1 for i, w in reversed(list(enumerate(COMMON)))}
#: Words learned from a table at most, and the documents that must hold one (so a table of fewer documents teaches none);
#: longer runs of letters, of any script, are no words.
WORDS, LEAST_DOCUMENTS, LONGEST_WORD = 50_000, 20, 24
LEET = str.maketrans("013457@$!", "oleastasi")
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
# What stands for a value that is kept elsewhere: marked as such, or a name with dots, whose parts are costed each for itself.
MARKED = re.compile(r"""\$\{?[A-Za-z_][A-Za-z0-9_.:-]*\}?|\{\{.*?\}\}|%[A-Za-z_]+%|<[A-Za-z_][A-Za-z0-9_ -]*>""")
DOTTED = re.compile(r"""(?:[A-Za-z_]+\.)+[A-Za-z_]+(?:[\[(]["']?[A-Za-z_]*["']?[\])])?(?=$|[^A-Za-z0-9])""")
# The address of a page, up to its query (one with a password in it is cut behind the user's name).
ADDRESS = re.compile(r"[a-z][a-z0-9+]{1,9}://(?:[^/\s:@]+:(?=[^/\s@]+@)|[^\s?#]*(?:#[A-Za-z_-]*(?=$|\s))?)")
MARKED_COST, ADDRESS_COST, NAME_COST = 2.0, 3.0, 2.0
# Parts of a name: runs of one case, a capital in front; those that can be spoken hold a vowel in every four letters.
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPOKEN = re.compile(r"(?i)(?!.*[^aeiouy]{4})(?=.*[aeiouy])[a-z]{3,}")
#: Repeats are offered to every end up to so many characters, and beyond to the end of their run.
NEAR = 64
DATE = re.compile(r"(?:(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d)")
DATE_COST, YEAR_COST = math.log10(366 * 120), math.log10(120)
SEGMENT_COST = 0.3


def brute_costs(value: str) -> list[float]:
    """log10 of the tries for each character; lower case in a run of four or more counts as pronounceable text."""
    out = []
    for m in re.finditer(r"[a-z]+|[^a-z]", value):
        run = m[0]
        out += [0.65 if len(run) >= 4 else 1.3] * len(run) if run[0].islower() and run.isascii() else [1.0 if run.isdigit() else 1.2 if run.isupper() else 1.5]
    return out


def _walks() -> dict[str, tuple[int, int]]:
    """Neighbours on the keyboard with their direction (keys to the right, rows down): along a row, and to the two keys that touch above and below."""
    at = {c: (x, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    # Each row lies half a key to the right of the one above, so down are the same place and the one before it.
    steps = ((1, 0), (-1, 0), (0, 1), (-1, 1), (0, -1), (1, -1))
    keys = {place: c for c, place in at.items()}
    return {a + keys[x + dx, y + dy]: (dx, dy) for a, (x, y) in at.items() for dx, dy in steps if (x + dx, y + dy) in keys}


WALKS = _walks()


def walk_end(value: str, start: int) -> tuple[int, int]:
    """End of the keyboard walk from `start`, and its number of turns and jumps to the next column.

    A walk goes on in one direction; from the end of a run of three keys or more that goes up or down it may start the
    next run beside the run's first key, as in 1qaz2wsx."""
    j, turns, first = start + 1, 0, start
    step = None
    while j < len(value):
        way = WALKS.get(value[j - 1 : j + 1])
        if way and step in (None, way):
            step = way
        elif step and step[1] and j - first >= 3 and WALKS.get(value[first] + value[j], (0, 1))[1] == 0:
            first, step, turns = j, None, turns + 1
        else:
            break
        j += 1
    # A column that has just begun, with no second key, belongs to what follows.
    return (j - 1, turns - 1) if turns and first == j - 1 else (j, turns)


def word_cost(part: str, ranks: dict[str, int]) -> float | None:
    """log10 of the guesses for a word, written plainly or with digits and signs for letters."""
    lower = part.lower()
    rank = ranks.get(lower)
    plain = rank or ranks.get(lower.translate(LEET))
    return None if plain is None else math.log10(plain + 1) + 0.3 * (part != lower) + 0.3 * (rank is None)


def name_cost(name: str, ranks: dict[str, int]) -> float:
    """log10 of the guesses for a name with dots: each part is a word, can be spoken (one name of a hundred), or is brute force."""
    total = 0.0
    for m in re.finditer(rf"{PARTS.pattern}|[^A-Za-z]", name):
        part = m[0]
        if not part[0].isalpha():
            total += 0.1
            continue
        cost = sum(brute_costs(part))
        word = word_cost(part, ranks) if len(part) > 1 else None
        total += min(cost, math.inf if word is None else word, NAME_COST if SPOKEN.fullmatch(part) else math.inf)
    return total


def segments_of(value: str, ranks: dict[str, int]) -> list[list[tuple[int, float, str]]]:
    """By end: start, cost and kind of every segment but those of brute force."""
    n = len(value)
    brute = brute_costs(value)
    total = [0.0, *itertools.accumulate(brute)]
    lower = value.lower()
    ends: list[list[tuple[int, float, str]]] = [[] for _ in range(n + 1)]
    for i in range(n):
        for j in range(i + 2, min(n, i + LONGEST_WORD) + 1):
            cost = word_cost(value[i:j], ranks)
            if cost is not None:
                ends[j].append((i, cost, "word"))
        for length in (4, 6, 8, 10):
            if DATE.fullmatch(value, i, i + length) and i + length <= n:
                ends[i + length].append((i, DATE_COST if length > 4 else YEAR_COST, "date"))
        for unit in range(1, min(8, n - i) + 1):
            least, j = max(3, 2 * unit), i + unit
            while j < n and value[j] == value[j - unit]:
                j += 1
                if i + least <= j <= i + NEAR:
                    ends[j].append((i, total[i + unit] - total[i] + math.log10((j - i) / unit), "repeat"))
                elif j > i + NEAR and i and value[i - 1] == value[i - 1 + unit]:
                    break  # a long run is offered whole from its first character
            if j > i + NEAR:
                ends[j].append((i, total[i + unit] - total[i] + math.log10((j - i) / unit), "repeat"))
        far, _ = walk_end(lower, i)
        for j in range(i + 3, far + 1):
            end, turns = walk_end(lower[:j], i)
            if end == j:
                ends[j].append((i, 1.6 + math.log10(j - i) + 0.3 * turns, "walk"))
        if i == 0 or not value[i - 1].isalnum():
            for pattern, cost, kind in ((MARKED, MARKED_COST, "reference"), (DOTTED, None, "reference"), (ADDRESS, ADDRESS_COST, "address")):
                m = pattern.match(value, i)
                if m:
                    ends[m.end()].append((i, name_cost(m[0], ranks) if cost is None else cost, kind))
    return ends


def guess_cost(value: str, ranks: dict[str, int] | None = None) -> tuple[float, list[tuple[int, int, str]]]:
    """log10 of the guesses for the cheapest segmentation, and its segments (start, end, kind)."""
    n = len(value)
    brute = brute_costs(value)
    ends = segments_of(value, RANKS if ranks is None else ranks)
    best = [0.0] + [math.inf] * n
    back: list[tuple[int, str]] = [(0, "")] * (n + 1)
    for j in range(1, n + 1):
        best[j], back[j] = best[j - 1] + brute[j - 1], (j - 1, "brute")
        for i, cost, kind in ends[j]:
            if best[i] + cost + SEGMENT_COST < best[j]:
                best[j], back[j] = best[i] + cost + SEGMENT_COST, (i, kind)
    segments: list[tuple[int, int, str]] = []
    j = n
    while j:
        i, kind = back[j]
        if segments and kind == "brute" and segments[-1][2] == "brute":
            segments[-1] = (i, segments[-1][1], kind)
        else:
            segments.append((i, j, kind))
        j = i
    return best[n], segments[::-1]


# --- ranked words

_LETTERS = re.compile(rf"(?<![^\W\d_])[^\W\d_]{{3,{LONGEST_WORD}}}(?![^\W\d_])")


def _counted(most: int = 200_000):
    """Per task the words of its documents with the number of documents that hold each, `most` words at a time."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def out(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    def task(batches):
        counts: Counter = Counter()
        for batch in slices(batches):
            for text in texts_of(batch):
                counts.update(set(_LETTERS.findall(text.lower())))
                if len(counts) > most:
                    yield out(counts)
                    counts.clear()
        if counts:
            yield out(counts)

    return task


def ranked_words(docs: DataFrame, words: int = WORDS, least: int = LEAST_DOCUMENTS) -> dict[str, int]:
    """Rank by word: those that guessers try first, then the `words` that most documents hold, `least` at least.

    Every document is counted; the driver gets `words` rows at most."""
    counted = bounded(docs).select("text").mapInArrow(_counted(), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    out = dict(RANKS)
    for r in counted.orderBy(F.desc("n"), "word").limit(words).collect():
        out.setdefault(r["word"], len(out) + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the fixed patterns."""
    out = []
    lower = None
    if "=" in text or ":" in text:
        lower = text.lower()
        if any(s in lower for s in ("passw", "secret", "token", "key")):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def value_of(m: re.Match) -> tuple[int, int]:
    """Where a credential's value lies. From one without quotes, commas and semicolons behind it and brackets that it does not open are taken off."""
    a, b = m.span(m.lastindex)
    if m.lastindex == 4:
        value = m[4]
        while b - a > 6 and (value[-1] in ",;" or (value[-1] in ")]}>" and value.count(value[-1]) > value.count("([{<"[")]}>".index(value[-1])]))):
            value, b = value[:-1], b - 1
    return a, b


def guessed_spans(text: str, limit: float = LIMIT, ranks: dict[str, int] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of credential values that are dear to guess."""
    lower = text.lower()
    if not any(s in lower for s in STEMS):
        return []
    return [(a, 3, b) for a, b in map(value_of, CONTEXT.finditer(text)) if guess_cost(text[a:b], ranks)[0] >= limit]


def uncovered(more: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that no base span holds whole."""
    return [s for s in more if not any(a <= s[0] and s[2] <= b for a, _, b in base)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_DDL = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_guess", pa.int64())])


def scan(docs: DataFrame, limit: float = LIMIT, ranks: dict[str, int] | None = None) -> DataFrame:
    """One row per document with its secrets; ranks: those of ranked_words(docs) unless others are given."""
    shipped = docs.sparkSession.sparkContext.broadcast(ranked_words(docs) if ranks is None else ranks)

    def task(batches):
        own = shipped.value
        for batch in slices(batches):
            rows = []
            for text in texts_of(batch):
                base = base_spans(text)
                more = uncovered(guessed_spans(text, limit, own), base)
                counts = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)), len(more)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(_SCHEMA)[1:], strict=True))], schema=_SCHEMA)

    return bounded(docs).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(task, _DDL)


def query(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
