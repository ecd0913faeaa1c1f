"""Quality classifier: random-indexing word vectors and a two-layer network.

A text's tokens are its words as written and the words' shapes (runs of upper,
lower, digit and other signs). Each hashed token has a fixed sparse random index
vector; its word vector adds the index vectors of the tokens around it in the
learned texts. A text is the mean of its words' vectors and of its shapes'. The network's last
output is divided by a temperature fitted on texts that it hasn't learned, and
then freed of the sample's class ratio where the classes were sampled unequally.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .models import Arrays, score_texts, train
from .text import U, Chunk, chunks, span_hashes, words

TOKEN_BITS = 15
DIMENSIONS = 32
HIDDEN = 16
EPOCHS = 15
INPUTS = 2 * DIMENSIONS + 4

_SHAPE = np.full(256, 4, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 3, 2, 1, 1


def tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word tokens, shape tokens, and where each text's words begin."""
    found = words(chunk)
    word = span_hashes(chunk.data, found.start, found.end)
    kind = _SHAPE[chunk.data]
    turn = np.ones(len(kind), dtype=bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[found.start] = True
    place = np.concatenate([[0], np.cumsum(turn)])
    shape = span_hashes(kind[turn], place[found.start], place[found.end])
    cut = U(64 - TOKEN_BITS)
    return (word >> cut).astype(np.int64), (shape >> cut).astype(np.int64), found.of_row


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors: four of the entries are +1 or -1."""
    random = np.random.default_rng(11)
    out = np.zeros((1 << TOKEN_BITS, DIMENSIONS), dtype=np.float32)
    at = random.random(out.shape).argsort(axis=1)[:, :4]
    np.put_along_axis(out, at, random.choice(np.array([-1, 1], dtype=np.float32), at.shape), axis=1)
    return out


def pooled(vectors: np.ndarray, chunk: Chunk) -> np.ndarray:
    """Mean word vector, mean shape vector, their lengths, the mean product of
    neighbouring words' vectors, and log(1 + words).

    The lengths and the product are near 1 where words repeat and small for varied
    texts. All is zero without words.
    """
    word, shape, begin = tokens(chunk)
    out = np.zeros((chunk.rows, INPUTS), dtype=np.float64)
    count = begin[1:] - begin[:-1]
    some = count > 0
    for k, kind in enumerate((word, shape)):
        if some.any():
            own = vectors[kind]
            mean = np.add.reduceat(own, begin[:-1][some], axis=0) / count[some, None]
            out[some, k * DIMENSIONS : (k + 1) * DIMENSIONS] = mean
            out[some, 2 * DIMENSIONS + k] = np.linalg.norm(mean, axis=1)
            if kind is word:
                beside = np.zeros(len(word))
                beside[1:] = np.einsum("ij,ij->i", own[1:], own[:-1])
                beside[begin[:-1][some]] = 0  # another text's word stands before
                out[some, -2] = np.add.reduceat(beside, begin[:-1][some]) / count[some]
    out[:, -1] = np.log1p(count)
    return out


def _context(texts: pa.Array, index: np.ndarray) -> np.ndarray:
    total = index.astype(np.float64) * 4
    for chunk in chunks(texts):
        word, shape, begin = tokens(chunk)
        row = np.repeat(np.arange(chunk.rows), begin[1:] - begin[:-1])
        around = np.zeros((len(word), DIMENSIONS), dtype=np.float32)
        for far in (1, 2):
            near = row[far:] == row[:-far]
            own = (index[word] + index[shape]).astype(np.float32)
            around[far:][near] += own[:-far][near]
            around[:-far][near] += own[far:][near]
        for kind in (word, shape):
            order = np.argsort(kind, kind="stable")
            found, at = np.unique(kind[order], return_index=True)
            if len(found):
                total[found] += np.add.reduceat(around[order], at, axis=0)
    return (total / np.linalg.norm(total, axis=1, keepdims=True)).astype(np.float32)


def forward(model: Arrays, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh((rows - model["mean"]) / model["scale"] @ model["w1"] + model["b1"])
    return hidden, hidden @ model["w2"] + model["b2"][0]


def _loss(logit: np.ndarray, label: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logit) - label * logit))


def learn(texts: pa.Array, labels: np.ndarray) -> Arrays:
    """Vectors, network (Adam on batches of 64) and temperature; every fifth text calibrates."""
    vectors = _context(texts, index_vectors())
    rows = np.concatenate([pooled(vectors, c) for c in chunks(texts)])
    random = np.random.default_rng(13)
    model = {
        "vectors": vectors.astype(np.float16), "mean": rows.mean(axis=0), "scale": rows.std(axis=0) + 1e-6, "temperature": np.ones(1),
        "w1": random.normal(0, INPUTS**-0.5, (INPUTS, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": random.normal(0, HIDDEN**-0.5, HIDDEN), "b2": np.zeros(1),
    }
    aside = np.arange(len(rows)) % 5 == 4
    x, y = rows[~aside], labels[~aside].astype(np.float64)
    names = ("w1", "b1", "w2", "b2")
    first, second, step = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
    for _ in range(EPOCHS):
        order = random.permutation(len(x))
        for k in range(0, len(x), 64):
            at = order[k : k + 64]
            hidden, logit = forward(model, x[at])
            error = (1 / (1 + np.exp(-logit)) - y[at]) / len(at)
            back = error[:, None] * model["w2"] * (1 - hidden**2)
            slope = {"w1": ((x[at] - model["mean"]) / model["scale"]).T @ back, "b1": back.sum(axis=0), "w2": hidden.T @ error, "b2": error.sum(keepdims=True)}
            step += 1
            for n in names:
                g = slope[n] + 1e-4 * model[n]
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.999 * second[n] + 0.001 * g * g
                model[n] = model[n] - 0.01 * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    if aside.any():
        logit = forward(model, rows[aside])[1]
        choices = np.geomspace(0.25, 8, 41)
        model["temperature"] = choices[[int(np.argmin([_loss(logit / t, labels[aside]) for t in choices]))]]
    return model


def score(model: Arrays, chunk: Chunk) -> np.ndarray:
    logit = forward(model, pooled(model["vectors"].astype(np.float32), chunk))[1]
    return 1 / (1 + np.exp(-np.clip(logit / model["temperature"][0] - model["shift"][0], -30, 30)))


def learn_quality(sample: DataFrame) -> bytes:
    return train(sample, learn)


def score_quality(docs: DataFrame, model: bytes) -> DataFrame:
    """``docs`` with ``score`` in (0, 1), higher for better texts; only ``text`` is read.

    Null and empty texts pool to the zero vector and get the network's score of it.
    With an empty model all scores are 0.5. Repeated rows score alike, an empty
    table gives no rows, other columns are kept and an old ``score`` is replaced.
    """
    return score_texts(docs, model, score, 0.5)
