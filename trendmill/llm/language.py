"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram binds the permuted
vectors of its letters by multiplication, a text bundles its trigrams by
addition, and a language's prototype bundles its learned texts. A document gets
the language whose prototype has the largest cosine with its bundle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .samples import fold
from .text import chunks

DIMENSIONS = 512
SYMBOLS = 64
SHARPNESS = 25.0


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Symbol of each code point: 0 for no letter, 1-26 for a-z, others share 27-63."""
    table = np.zeros(0x110000, dtype=np.uint8)
    letters = np.fromiter((c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()), dtype=np.int64)
    table[letters] = 27 + letters % (SYMBOLS - 27)
    table[97:123] = np.arange(1, 27)
    return table


class TrigramVectors:
    """Bound vectors of trigrams, made from letter vectors when first met."""

    def __init__(self):
        letters = np.random.default_rng(7).choice(np.array([-1, 1], dtype=np.int8), (SYMBOLS, DIMENSIONS))
        self.letters = [np.roll(letters, k, axis=1) for k in (2, 1, 0)]
        self.row = np.full(SYMBOLS**3, -1, dtype=np.int32)
        self.table = np.zeros((1024, DIMENSIONS), dtype=np.int8)
        self.used = 0

    def __getitem__(self, trigrams: np.ndarray) -> np.ndarray:
        new = trigrams[self.row[trigrams] < 0]
        if len(new):
            while self.used + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.row[new] = np.arange(self.used, self.used + len(new))
            a, b, c = new // SYMBOLS**2, new // SYMBOLS % SYMBOLS, new % SYMBOLS
            self.table[self.used : self.used + len(new)] = self.letters[0][a] * self.letters[1][b] * self.letters[2][c]
            self.used += len(new)
        return self.table[self.row[trigrams]]


@lru_cache(maxsize=1)
def _vectors() -> TrigramVectors:
    return TrigramVectors()


def bundles(texts: list[str]) -> np.ndarray:
    """One float vector per text; zero if it has no letter."""
    vectors, symbols = _vectors(), symbol_table()
    lowered = [t.lower() for t in texts]
    at = np.cumsum([0] + [len(t) + 1 for t in lowered])
    points = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    own = symbols[points].astype(np.int32)
    trigrams = own[:-2] * SYMBOLS**2 + own[1:-1] * SYMBOLS + own[2:]
    inner = own[1:-1] > 0
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    for k in range(len(texts)):
        a, b = at[k], at[k + 1] - 1
        found, count = np.unique(trigrams[a:b][inner[a:b]], return_counts=True)
        if len(found):
            out[k] = count.astype(np.float32) @ vectors[found].astype(np.float32)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def _bundle_by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        texts = batch.column(1).fill_null("")
        for chunk in chunks(texts):
            langs = batch.column(0).slice(chunk.first, chunk.rows).to_pylist()
            for lang, own in zip(langs, _unit(bundles(texts.slice(chunk.first, chunk.rows).to_pylist())), strict=True):
                total[lang] = total.get(lang, 0) + own.astype(np.float64)
    if total:
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(total)), "bundle": pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))})


def learn_profiles(docs: DataFrame, *, per_language: int = 400, fold_parts: int = 5, held_out: int = 0) -> dict[str, list[float]]:
    """Prototypes of all non-null languages outside the held-out fold.

    About ``per_language`` texts of each language are used, chosen by a hash of
    the id; fewer if there are fewer. One vector per language reaches the driver.
    """
    known = docs.where(F.col("lang").isNotNull() & (fold("doc_id", fold_parts) != held_out))
    counts = known.groupBy("lang").count()
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("count"))
    # one row per language
    chosen = known.select("doc_id", "lang", "text").join(F.broadcast(counts), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    parts = chosen.select("lang", "text").mapInArrow(_bundle_by_language, "lang string, bundle array<double>")
    summed = parts.select("lang", F.posexplode("bundle")).groupBy("lang", "pos").agg(F.sum("col").alias("v"))
    rows = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("bundle")).orderBy("lang").collect()
    return {r["lang"]: [x["v"] for x in r["bundle"]] for r in rows}


def identify_language(docs: DataFrame, profiles: dict[str, list[float]]) -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``score``.

    ``score`` (0 to 1) is the softmax share of the best cosine. A text that is null
    or has no letter, or an empty set of profiles, gives ``und`` and 0. Ties go to
    the first language in alphabetical order. Only the text is read; repeated rows,
    null ids and further columns are kept as they are; columns of the two new names
    are replaced.
    """
    names = sorted(profiles)
    shared = docs.sparkSession.sparkContext.broadcast(_unit(np.array([profiles[n] for n in names], dtype=np.float64).reshape(len(names), -1)).astype(np.float32) if names else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prototypes = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).fill_null("")
            for chunk in chunks(texts):
                own = bundles(texts.slice(chunk.first, chunk.rows).to_pylist())
                some = own.any(axis=1) & bool(names)
                best, score = np.zeros(chunk.rows, dtype=np.int64), np.zeros(chunk.rows)
                if some.any():
                    cosine = (_unit(own[some]) @ prototypes.T).astype(np.float64)
                    best[some] = cosine.argmax(axis=1)
                    score[some] = 1 / np.exp(SHARPNESS * (cosine - cosine.max(axis=1, keepdims=True))).sum(axis=1)
                found = [names[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                kept = [c.slice(chunk.first, chunk.rows) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    kept = docs.drop("lang_pred", "score")
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *added]))
