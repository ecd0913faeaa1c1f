"""Training on a bounded sample in one task, and scoring texts with the result."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import Chunk, chunks

Arrays = dict[str, np.ndarray]


def prior_shift(labels: np.ndarray, rates: np.ndarray) -> float:
    """What unequal sampling of the classes adds to the log-odds of class 1; 0 if one is missing."""
    either = [rates[labels == k] for k in (0, 1)]
    return float(np.log(either[1].mean() / either[0].mean())) if len(either[0]) and len(either[1]) else 0.0


def fit(rows: DataFrame, learn: Callable[[pa.Table], Arrays]) -> bytes:
    """Run ``learn`` over a bounded number of rows in one task; returns an npz file, empty without rows.

    The rows keep the order they have within the one partition of ``rows``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        file = io.BytesIO()
        np.savez(file, **learn(pa.Table.from_batches(held).combine_chunks()))
        yield pa.RecordBatch.from_pydict({"model": pa.array([file.getvalue()], pa.binary())})

    found = rows.mapInArrow(run, "model binary").collect()
    return bytes(found[0]["model"]) if found else b""


def train(sample: DataFrame, learn: Callable[[pa.Array, np.ndarray], Arrays]) -> bytes:
    """Run ``learn(texts, labels)`` over a sample of bounded size; returns an npz file.

    The sample is read in the order of a hash of its ids, so a lost executor and a
    second run give the same model. An empty sample gives an empty model. The
    model's ``shift`` is to be subtracted from a log-odds: it comes from the column
    ``rate``, the sampled share of a row's class; without it all is taken.
    """
    rate = F.col("rate").cast("double") if "rate" in sample.columns else F.lit(1.0)

    def of_table(held: pa.Table) -> Arrays:
        labels = held.column("label").to_numpy()
        return learn(held.column("text").combine_chunks(), labels) | {"shift": np.array([prior_shift(labels, held.column("rate").to_numpy())])}

    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text")
    return fit(ordered.select(F.coalesce("text", F.lit("")).alias("text"), "label", rate.alias("rate")), of_table)


def load(model: bytes) -> Arrays:
    return dict(np.load(io.BytesIO(model))) if model else {}


def score_texts(docs: DataFrame, model: bytes, score: Callable[[Arrays, Chunk], np.ndarray], empty: float) -> DataFrame:
    """All columns of ``docs`` (but an old ``score``) and ``score`` of ``text``; ``empty`` if there is no model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = load(shared.value)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for chunk in chunks(batch.column(at)):
                own = score(arrays, chunk) if arrays else np.full(chunk.rows, empty)
                kept = [c.slice(chunk.first, chunk.rows) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(own.astype(np.float64))], names=[*batch.schema.names, "score"])

    kept = docs.drop("score")
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())]))
