"""Secrets: fixed patterns, and values in credential contexts that are dear to guess.

What stands after a word such as "pwd:", "Bearer" or a user's name in an address is
segmented into common words, dates, repeats, keyboard walks and brute-forced letters
so that the product of their guesses is least; the value is a secret if that is
still large. The words are those of the corpus, ranked by their count over all
texts; the list has a stated size and is broadcast.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import stored
from .text import chunks

Span = tuple[int, int, str]
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "guess")
PATTERNS = {
    "assign": re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)""", re.A),
    "access": re.compile(r"AKIA[A-Z0-9]++"),
    "hex": re.compile(r"[0-9a-f]{24,}+"),
}
#: a credential's name and what parts it from its value; the value itself is whatever has no space, quote or bracket
CONTEXT = re.compile(
    r"""(?:\b|_)(?i:pass(?:word|wd|phrase|code|wort)?|pwd|kennwort|contraseña|mot\x20de\x20passe|secret|token|credentials?|pin|(?:api|access|private|secret|auth)[_\x20-]?key|bearer|basic)\b["']?(?:\x20{0,3}(?:[:=]>?|->)\x20{0,3}|\x20{1,3}(?:is|ist|est|es)\x20{1,3}|(?<=(?i:bearer|.basic))\x20)["'`]?"""
)
IN_ADDRESS = re.compile(r"""://[^/\s:@"'`<>]{1,64}:([^/\s@"'`<>]++)@""")
NAMES = ("pass", "pwd", "kennwort", "contraseña", "secret", "token", "credential", "pin", "key", "bearer", "basic")  # without any no context
VALUE = re.compile(r"""[^\s"'`<>]++""")
TRAILING = ".,;:!?)]}|"
DATE = re.compile(r"(?:19|20)[0-9]{2}(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12][0-9]|3[01]))?)?|(?:0[1-9]|[12][0-9]|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:(?:19|20)[0-9]{2}|[0-9]{2})")
#: fixed: rows of keys as they lie below each other
KEYS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
#: fixed: what stands for a letter
LEET = str.maketrans("4301$5@7", "aeoissat")
#: fixed: words that many choose, whatever the corpus
USUAL = ("password", "passwort", "admin", "root", "letmein", "welcome", "login", "master", "dragon", "monkey", "secret", "test", "guest", "user", "summer", "winter", "love", "hello", "changeme", "default", "example", "null", "none", "true", "false")
LEAST_LENGTH, LONGEST_WORD, DEAR = 6, 24, 12.0


def pattern_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that pass their check, by start and then kind. Time is linear in the text."""
    low, found = text.lower(), []
    if any(name in low for name in ("passw", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in PATTERNS["assign"].finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in PATTERNS["access"].finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in PATTERNS["hex"].finditer(text)]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


# ---- guesses --------------------------------------------------------------


@lru_cache(maxsize=1)
def neighbours() -> dict[str, set[str]]:
    """Keys that touch each key."""
    at = {c: (r, k) for r, row in enumerate(KEYS) for k, c in enumerate(row)}
    return {c: {d for d, (q, j) in at.items() if d != c and abs(q - r) <= 1 and abs(j - k + (q - r) / 2) <= 1} for c, (r, k) in at.items()}


def letter_guesses(c: str) -> float:
    """Decimal logarithm of the guesses for one letter by brute force: the size of its class."""
    return log10(10 if c.isdigit() else 26 if c.islower() or c.isupper() else 33 if c.isascii() else 100)


def word_guesses(piece: str, low: str, plain: str, ranks: dict[str, int]) -> float | None:
    """Of a common word in any case, with letters exchanged for signs: its rank, and the ways to write it."""
    rank = ranks.get(low) or ranks.get(plain)
    if not rank:
        return None
    raised = 0 if piece == low else 1 if piece in (low.capitalize(), low.upper()) else sum(map(str.isupper, piece))
    return log10(rank + 1) + log10(2) * (raised + (0 if low in ranks else sum(a != b for a, b in zip(low, plain, strict=True))))


def walk_end(low: str, at: int) -> int:
    """Where the keyboard walk, or the run of following letters or digits, that begins at ``at`` ends."""
    near, stop = neighbours(), at + 1
    while stop < len(low) and low[stop] in near.get(low[stop - 1], ()):
        stop += 1
    for step in (1, -1):
        other = at + 1
        while other < len(low) and low[other].isalnum() and ord(low[other]) - ord(low[other - 1]) == step:
            other += 1
        stop = max(stop, other)
    return stop


def repeat_end(value: str, at: int, unit: int) -> int:
    """Where the repeats of the ``unit`` letters at ``at`` end; ``at`` itself if there is none."""
    piece, stop = value[at : at + unit], at + unit
    while value.startswith(piece, stop):
        stop += unit
    return stop if stop > at + unit else at


def guesses(value: str, ranks: dict[str, int], enough: float = float("inf")) -> float:
    """Decimal logarithm of the guesses that the cheapest segmentation of ``value`` takes, or ``enough`` if there are more.

    Dynamic programming from left to right; each segment but the first costs a factor
    of two for its place. A position tries words of at most ``LONGEST_WORD`` letters,
    one date, one walk and four repeats, so time grows with the value's length.
    """
    size, letter = len(value), [letter_guesses(c) for c in value]
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    best = [0.0] + [float("inf")] * size
    brute = [False] * (size + 1)  # does the best way end with a brute-forced letter?
    walked, cheap, repeated = 0, 0, [0, 0, 0, 0]
    for at in range(size):
        if at > cheap:  # no way beyond this place is cheaper than enough
            return enough
        ways = [(at + 1, letter[at], True)]
        for stop in range(at + 3, min(size, at + LONGEST_WORD) + 1):
            cost = word_guesses(value[at:stop], low[at:stop], plain[at:stop], ranks)
            if cost is not None:
                ways.append((stop, cost, False))
        date = DATE.match(value, at)
        if date:
            ways.append((date.end(), log10(365 * 150) if date.end() - at > 4 else log10(150), False))
        if at >= walked - 2:  # within a walk only its end may begin another
            walked = walk_end(low, at)
        ways += [(stop, log10(47 * 4 * (stop - at)), False) for stop in {at + 3, walked} if at + 3 <= stop <= walked]
        for unit in (1, 2, 3, 4):
            if at >= repeated[unit - 1]:
                stop = repeated[unit - 1] = repeat_end(value, at, unit)
                if stop - at >= 3:
                    ways.append((stop, sum(letter[at : at + unit]) + log10((stop - at) / unit), False))
        for stop, cost, forced in ways:
            total = best[at] + cost + (log10(2) if at and not (forced and brute[at]) else 0)
            if total < best[stop]:
                best[stop], brute[stop] = total, forced
                if total < enough:
                    cheap = max(cheap, stop)
    return min(enough, best[size])


def guessed_spans(text: str, ranks: dict[str, int], dear: float = DEAR) -> list[Span]:
    """Values of credential contexts that take at least ``10 ** dear`` guesses; a value holds no further context."""
    found, low = [], text.lower()
    if "://" in text:
        found += [m.span(1) for m in IN_ADDRESS.finditer(text)]
    if any(name in low for name in NAMES):
        at = 0
        while context := CONTEXT.search(text, at):
            at = context.end()
            if value := VALUE.match(text, at):
                found.append((at, at + len(value.group().rstrip(TRAILING))))
                at = value.end()
    return [(a, b, "guess") for a, b in sorted(found) if b - a >= LEAST_LENGTH and guesses(text[a:b], ranks, dear) >= dear]


def with_base(base: list[Span], added: list[Span]) -> list[Span]:
    """All base spans, and of the added ones, from the left, those that overlap none before."""
    taken: list[list[int]] = []
    for a, b, _ in base:
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    starts, at, kept = [a for a, _ in taken], 0, []
    for a, b, kind in added:
        before = bisect_left(starts, b)
        if a >= at and (not before or taken[before - 1][1] <= a):
            kept.append((a, b, kind))
            at = b
    return in_order([*base, *kept])


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


# ---- on tables ------------------------------------------------------------

LETTERS = re.compile(r"[^\W\d_]{3,}")
HELD = 200_000


def common_words(docs: DataFrame, limit: int = 30_000) -> list[str]:
    """The ``limit`` most frequent words of three letters and more of all texts, lower-cased, ties by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(list(held.keys()), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

        for batch in batches:
            for text in batch.column(0):
                held.update(w for w in LETTERS.findall((text.as_py() or "").lower()) if len(w) <= LONGEST_WORD)
                if len(held) > HELD:
                    yield counted()
                    held.clear()
        yield counted()

    found = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = stored(found.withColumn("size", F.floor(8 * F.log2("n"))))
    # how many words there are of each order of size: some hundred rows; the list's words are of the largest ones
    least, held = 0, 0
    for r in found.groupBy("size").count().orderBy(F.desc("size")).collect():
        least, held = r["size"], held + r["count"]
        if held >= limit:
            break
    return [r["word"] for r in found.where(F.col("size") >= least).orderBy(F.desc("n"), "word").limit(limit).collect()]


def find_secrets(docs: DataFrame, words: list[str], *, dear: float = DEAR) -> DataFrame:
    """All columns of ``docs`` and what is found in ``text``.

    Adds ``n_assign, n_access, n_hex`` (matches of the patterns), ``base_sha256`` of
    their spans as ``kind:start:end`` (code points, end exclusive) and ``spans``, those
    with the values dear to guess. A null or empty text has none. Rows are independent:
    order, repeats and null ids change nothing; old columns of the new names are
    replaced, others kept; without ``words`` only brute force is cheap.
    """
    names = [f"n_{k}" for k in BASE]
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = {w: k for k, w in reversed([*enumerate((*USUAL, *shared.value), 1)])}
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for chunk in chunks(batch.column(at)):
                kept = [c.slice(chunk.first, chunk.rows) for c in batch.columns]
                texts = [t or "" for t in kept[at].to_pylist()]
                base = [pattern_spans(t) for t in texts]
                spans = [with_base(b, guessed_spans(t, ranks, dear)) for b, t in zip(base, texts, strict=True)]
                counts = [pa.array([sum(s[2] == kind for s in own) for own in base], pa.int64()) for kind in BASE]
                digest = pa.array([hashlib.sha256(written(own).encode()).hexdigest() for own in base])
                yield pa.RecordBatch.from_arrays([*kept, *counts, digest, pa.array([written(s) for s in spans], pa.string())], names=[*batch.schema.names, *names, "base_sha256", "spans"])

    own = docs.drop(*names, "base_sha256", "spans")
    fields = [*(T.StructField(n, T.LongType()) for n in names), *(T.StructField(n, T.StringType()) for n in ("base_sha256", "spans"))]
    return own.mapInArrow(run, T.StructType([*own.schema.fields, *fields]))
