"""The corpus pipeline: five stages over ``documents``, each written before the next.

Language identification drops what has no language, the n-gram join keeps one
document of each group of near copies, personal data is replaced by its kind,
the documents are put in the mixture's order, and the last stage encodes them and
tells each one's place in that order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendmill.llm.bpe import bpe_encode_decode
from trendmill.llm.language import identify_language, learn_profiles
from trendmill.llm.mixing import in_mixed_order, mix_sources, root_weights
from trendmill.llm.ngram_join import ngram_components
from trendmill.llm.pii import find_pii, learn_tagger
from trendmill.llm.storage import small, split_by_keys, stored

LEAST_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with a language; ``und`` and scores below 0.35 (no language leads) go.

    A null or empty text and one without a letter have none. Each row is decided by
    its text alone: null ids, repeated rows and ties (the first language in
    alphabetical order) change nothing. An empty table gives no rows.
    """
    named = identify_language(docs, learn_profiles(docs))
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, of these with the smallest text hash.

    Null ids come last, and count as documents of their own. Rows of one id with
    different texts are told apart. Of rows with equal id and text one stays, the
    first by the other columns. Texts without words have no copies but such rows.
    """
    key = ["_row", "_nameless", "_key"]
    others = stored(ngram_components(docs).where("NOT is_first").select(*_row_key(F.col("doc_id").cast("long"), F.col("text_key"))).distinct())
    keyed = docs.select("*", *_row_key(F.col("doc_id").cast("long"), F.xxhash64("text")))
    repeated = keyed.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")
    # most texts are neither dropped nor repeated, and stay where they are
    some, alone = split_by_keys(keyed, others.select("_key").unionByName(repeated.select("_key")), "_key")
    # the join and the window share their keys, so the others are shuffled once
    kept = some.join(others.hint("shuffle_hash"), key, "left_anti")
    again = ", ".join(f"`{c}`" for c in docs.columns if c not in ("doc_id", "text")) or "doc_id"
    first = kept.withColumn("_again", F.expr(f"row_number() OVER (PARTITION BY _row, _nameless, _key ORDER BY {again})")).where("_again = 1")
    return first.select(docs.columns).unionByName(alone.select(docs.columns))


def _row_key(own: Column, key: Column) -> list[Column]:
    """An id that may be null and the hash of its text, as columns that are never null."""
    return [F.coalesce(own, key).alias("_row"), own.isNull().alias("_nameless"), key.alias("_key")]


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every span of personal data becomes its kind in brackets; ``n_chars`` follows.

    All rows stay, in any number of copies; a null text stays null, an empty one empty.
    """
    clean = find_pii(docs, learn_tagger(docs), redact=True)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, written in the order of the mixture by square-root weights.

    The order is in the files: ``encoding`` reads it from them. A null source is one
    of its own; rows of equal id and source share any of their places.
    """
    return in_mixed_order(mix_sources(docs, root_weights(docs))).select(docs.columns)


def in_file_order(docs: DataFrame) -> DataFrame:
    """``docs`` with ``file`` and ``row``: where each row stands in the files that it was read from.

    Files of one writing sort by their names. A table that isn't read from files has
    the order of its partitions.
    """
    try:
        name = F.col("_metadata.file_name")
        return docs.select("*", F.concat(F.lpad(F.length(name).cast("string"), 4, "0"), name).alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return docs.select("*", F.lpad(F.spark_partition_id().cast("string"), 10, "0").alias("file"), F.monotonically_increasing_id().alias("row"))


def encoding(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every document, in decimal, digests of ids and decoded text, and the document's place in the mixture.

    ``position`` counts all rows before, from 0. Null and empty texts have no tokens.
    """
    placed = in_file_order(docs.select("doc_id", "text"))
    counts = placed.groupBy("file").agg(F.count("*").alias("rows"), F.min("row").alias("first"))
    # one row per file
    before = counts.select("file", "first", F.expr("coalesce(sum(rows) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("before"))
    done = bpe_encode_decode(placed, public_tokenizers.path("word_bpe_49k.json"), keep=("file", "row")).join(small(before), "file")
    return done.select("doc_id", (F.col("before") + F.col("row") - F.col("first")).alias("position"), "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing", mixing),
    ("BPE", encoding),
]

#: Trained taggers and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
