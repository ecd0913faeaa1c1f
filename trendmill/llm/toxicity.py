"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Words are runs of letters and digits, A-Z lower-cased. A text's features are its
distinct words, neighbouring pairs and pairs with one word between, hashed to
2**20 coordinates. Learning rates are per coordinate and L1 leaves few weights.
Unequal sampling of the classes is taken back from the log-odds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as tx
from .models import Arrays, score_texts, train
from .text import LOWER, U, Chunk, chunks, fold, mix, span_hashes, words

FEATURE_BITS = 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 15.0, 1.0
EPOCHS = 6

_PLAIN = np.full(256, 0x20, dtype=np.uint8)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _PLAIN[_low:_high] = LOWER[_low:_high]


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Feature coordinates of all texts, and where each text's begin; repeats included."""
    plain = Chunk(chunk.first, _PLAIN[chunk.data], chunk.offsets)
    found = words(plain)
    one = span_hashes(plain.data, found.start, found.end)
    begin, end = found.of_row[:-1], found.of_row[1:]
    last = np.repeat(end, end - begin)
    place = np.arange(len(one))
    kinds, rows = [one], [place]
    if len(one) > 1:
        ok = place[:-1] + 1 < last[:-1]
        kinds.append(fold(one, 2)[ok])
        rows.append(place[:-1][ok])
    if len(one) > 2:
        ok = place[:-2] + 2 < last[:-2]
        kinds.append(mix(one[:-2] * U(tx.BASE) + mix(one[2:]))[ok])
        rows.append(place[:-2][ok])
    at = np.concatenate(rows)
    order = np.argsort(at, kind="stable")
    coordinates = (np.concatenate(kinds) >> U(64 - FEATURE_BITS)).astype(np.int64)[order]
    return coordinates, np.searchsorted(at[order], found.of_row)


def learn(texts: pa.Array, labels: np.ndarray) -> Arrays:
    """FTRL-proximal over the texts in the given order, ``EPOCHS`` times."""
    held = []
    for chunk in chunks(texts):
        coordinates, begin = features(chunk)
        held += [np.unique(coordinates[a:b]).astype(np.int32) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
    size = 1 << FEATURE_BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        limit = np.where(at == size, 0.0, L1)
        own = z[at]
        return np.where(np.abs(own) <= limit, 0.0, (np.sign(own) * limit - own) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for own, label in zip(held, labels.tolist(), strict=True):
            at = np.append(own, size)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    final = weights(np.arange(size + 1))
    at = np.flatnonzero(final[:-1])
    return {"at": at.astype(np.int32), "weight": final[at], "bias": final[-1:]}


def score(model: Arrays, chunk: Chunk) -> np.ndarray:
    """Probability of each text; every distinct coordinate with a weight counts once."""
    weight = np.zeros(1 << FEATURE_BITS)
    weight[model["at"]] = model["weight"]
    coordinates, begin = features(chunk)
    used = np.flatnonzero(weight[coordinates])
    row = np.searchsorted(begin, used, "right") - 1
    both = np.unique(row * (1 << FEATURE_BITS) + coordinates[used])
    total = np.bincount(both >> FEATURE_BITS, weight[both & ((1 << FEATURE_BITS) - 1)], minlength=chunk.rows)
    return 1 / (1 + np.exp(-np.clip(total + model["bias"][0] - model["shift"][0], -30, 30)))


def learn_toxicity(sample: DataFrame) -> bytes:
    return train(sample, learn)


def score_toxicity(docs: DataFrame, model: bytes) -> DataFrame:
    """``docs`` with ``score`` in (0, 1); only ``text`` is read.

    Null and empty texts have no feature and get the score of bias and shift alone. With
    an empty model all scores are 0. Repeated rows score alike, an empty table
    gives no rows, other columns are kept and an old ``score`` is replaced.
    """
    return score_texts(docs, model, score, 0.0)
