"""Quality rules whose cutoffs carry a guarantee.

Every text gets a few counts. A rule compares a ratio of them with a cutoff. The
cutoffs come from labelled holdouts: in each stratum a rule's candidate cutoffs
are tested from the most lenient on, and a cutoff is accepted while the exact
binomial (Clopper-Pearson) upper bound of its share of rejected good texts stays
below the allowed risk. Testing in this fixed order needs no correction within a
rule; the error level is divided by the number of rules and strata.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .samples import fold
from .text import Chunk, chunks, fold as fold_hashes, span_hashes, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_same_next")
#: Each rule's ratio, of counts only; a larger one is worse.
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "same_next": ("n_same_next", "n_words"),
}
GRID = 50

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_POINT = np.ones(256, dtype=bool)
_POINT[0x80:0xC0] = False


def count_chunk(chunk: Chunk) -> dict[str, np.ndarray]:
    """The counts of every text of a chunk."""
    data, offsets = chunk.data, chunk.offsets
    found = words(chunk)
    begin, end = found.of_row[:-1], found.of_row[1:]
    hashes = span_hashes(data, found.start, found.end)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[offsets[1:]] - total[offsets[:-1]]

    visible = np.concatenate([[0], np.cumsum(_POINT[data])])
    chars = np.concatenate([[0], np.cumsum(visible[found.end] - visible[found.start])])
    same = np.zeros(len(hashes) + 1, dtype=np.int64)
    if len(hashes) > 1:
        equal = hashes[1:] == hashes[:-1]
        equal[begin[(begin > 0) & (begin < len(hashes))] - 1] = False
        same[2:] = np.cumsum(equal)
    windows = fold_hashes(hashes, 3)
    repeat, lines, dup = (np.zeros(chunk.rows, dtype=np.int64) for _ in range(3))
    breaks = np.flatnonzero(data == 10)
    line_from = np.searchsorted(breaks, offsets)
    for k, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
        if b - a >= 3:
            _, back, count = np.unique(windows[a : b - 2], return_inverse=True, return_counts=True)
            twice = np.flatnonzero(count[back] > 1)
            if len(twice):
                mark = np.zeros(b - a, dtype=bool)
                for step in range(3):
                    mark[twice + step] = True
                repeat[k] = mark.sum()
        if b > a:
            border = np.concatenate([[offsets[k]], breaks[line_from[k] : line_from[k + 1]] + 1])
            stop = np.concatenate([border[1:] - 1, [offsets[k + 1]]])
            filled = np.searchsorted(found.start, border) < np.searchsorted(found.start, stop)
            if (size := int(filled.sum())) > 1:
                dup[k] = size - len(np.unique(span_hashes_of(data, border[filled], stop[filled])))
            lines[k] = size
    return {
        "n_words": end - begin, "word_chars": chars[end] - chars[begin], "n_symbols": per_text(_SYMBOL[data]), "n_dup_lines": dup, "n_repeat_words": repeat,
        "n_upper": per_text(_UPPER[data]), "n_same_next": same[end] - same[begin], "n_lines": lines,
    }


def span_hashes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of a few spans, from the bytes between the first and the last alone."""
    low = int(start[0])
    return span_hashes(data[low : int(end[-1])], start - low, end - low)


def count_texts(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` but ``text``, and the counts (long). Null counts as no words.

    Words are runs of bytes other than 0x20 and 0x09-0x0D. ``n_dup_lines`` counts
    lines with a word that equal an earlier line of the text; ``n_repeat_words``
    counts words inside any three-word window found twice or more in the text.
    Lines and windows are compared by 64-bit hashes.
    """
    names = (*COUNTS, "n_lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            kept = [n for n in batch.schema.names if n != "text"]
            for chunk in chunks(batch.column(at)):
                counts = count_chunk(chunk)
                columns = [batch.column(batch.schema.get_field_index(n)).slice(chunk.first, chunk.rows) for n in kept]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(counts[n].astype(np.int64)) for n in names)], names=[*kept, *names])

    own = docs.drop(*names)
    fields = [f for f in own.schema.fields if f.name != "text"] + [T.StructField(n, T.LongType()) for n in names]
    return own.mapInArrow(run, T.StructType(fields))


def stratum() -> Column:
    """Texts are judged among texts of like length."""
    n = F.col("n_words")
    return F.when(n < 100, "short").when(n < 400, "middle").when(n < 2000, "long").otherwise("huge")


def level(rule: str) -> Column:
    """A rule's ratio in steps of 1 / GRID, rounded up; 0 where nothing is counted."""
    top, base = RULES[rule]
    return F.when(F.col(base) > 0, F.least(F.ceil(F.col(top) * GRID / F.col(base)), F.lit(4 * GRID))).otherwise(0).cast("int")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (about sqrt(a + b) steps)."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    top, low = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    value, step, change = low, 0, 0.0
    while abs(change - 1) > 1e-13:
        step += 1
        change = 1.0
        for term in (step * (b - step) / ((a + 2 * step - 1) * (a + 2 * step)), -(a + step) * (a + b + step) / ((a + 2 * step) * (a + 2 * step + 1))):
            low, top = 1 / (1 + term * x * low), 1 + term * x / top
            change *= low * top
            value *= low * top
    return value * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a


def at_most(bad: int, size: int, rate: float) -> float:
    """Probability of at most ``bad`` of ``size`` at this rate."""
    return 1.0 if bad >= size else incomplete_beta(size - bad, bad + 1, 1 - rate)


def upper_bound(bad: int, size: int, error: float) -> float:
    """Clopper-Pearson: the largest rate under which at most ``bad`` of ``size`` has probability ``error``."""
    if bad >= size:
        return 1.0
    low, high = bad / size, 1.0
    for _ in range(60):
        p = (low + high) / 2
        low, high = (p, high) if at_most(bad, size, p) > error else (low, p)
    return high


def choose_cutoffs(counted: DataFrame, labels: DataFrame, *, risk: float = 0.05, error: float = 0.1, fold_parts: int = 4, held_out: int = 2) -> dict[tuple[str, str], int]:
    """Largest allowed level per (stratum, rule); a missing pair never rejects.

    Every good (quality 1) row outside the held-out fold is counted; only counts
    per stratum, rule and level reach the driver. ``risk`` is shared evenly by the
    rules, so that a stratum's good texts lose at most ``risk`` in all, and ``error``
    by rules and strata (Bonferroni). A null or double label counts as its minimum. A
    stratum of fewer than about 500 good rows can't guarantee anything: it gets none.
    """
    good = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = counted.where(fold("doc_id", fold_parts) != held_out).join(good, "doc_id", "left_semi")
    pairs = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), level(r).alias("level")) for r in RULES))).alias("p")
    rows = held.select(stratum().alias("stratum"), pairs).groupBy("stratum", "p.rule", "p.level").count().collect()
    tables: dict[tuple[str, str], dict[int, int]] = {}
    for r in rows:
        tables.setdefault((r["stratum"], r["rule"]), {})[r["level"]] = r["count"]
    share = error / max(1, len(RULES) * len({s for s, _ in tables}))
    cutoffs = {}
    for pair, table in tables.items():
        size = sum(table.values())
        for cut in range(4 * GRID - 1, -1, -1):
            lost = sum(n for at, n in table.items() if at > cut)
            if at_most(lost, size, risk / len(RULES)) > share:  # the upper bound exceeds the risk
                break
            cutoffs[pair] = cut
    return cutoffs


def judge(counted: DataFrame, cutoffs: dict[tuple[str, str], int]) -> DataFrame:
    """Adds ``base_failed`` and ``kept``.

    The base rule fails texts of fewer than 50 words, or with more than half of
    their words in repeated windows. ``kept`` is false for those and for texts
    beyond a cutoff of their stratum. Texts without words fail the base rule. Old
    columns of these names, like old counts in ``count_texts``, are replaced.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    beyond = F.lit(False)
    for (own, rule), cut in sorted(cutoffs.items()):
        beyond = beyond | ((stratum() == own) & (level(rule) > cut))
    return counted.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~beyond)
