"""Bounded, repeatable samples of labelled rows, and the fixed folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, limit: int, *, fold_parts: int = 4, held_out: int = 2) -> DataFrame:
    """``text, label, rate`` of at most ``limit`` labelled ids of either class outside the held-out fold.

    The ids come first, in hash order, from the narrow label table; only their
    rows of ``docs`` are then kept. A doubly labelled id counts as its lower label.
    ``rate`` is the share of the class's ids that the limit leaves.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).where(fold("doc_id", fold_parts) != held_out)
    either = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit) for k in (0, 1)]
    # a class of at most limit ids is taken whole
    rates = known.groupBy("label").agg(F.least(F.lit(1.0), F.lit(limit) / F.count("*")).alias("rate"))
    chosen = either[0].unionByName(either[1]).join(F.broadcast(rates), "label")
    # at most 2 * limit rows of three numbers
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label", "rate")
