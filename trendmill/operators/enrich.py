"""Enrichment by a user's function over batches, and the merging of its results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import render_tags
from .feeds import in_feed
from .rules import SAMPLE, Tables, is_junk
from .state import promoted


def batched_scores(df: DataFrame, score: Callable[[list[dict]], list], columns: tuple[str, ...], schema: str, size: int = 50) -> DataFrame:
    """K1, K2: ``id`` and the fields of ``schema`` from ``score(rows)``, ``size`` rows a call.

    A result that is missing, and every result of a failing call, is null; ``failed``
    tells the latter.
    """
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), size):
                part = frame.iloc[a : a + size]
                failed = False
                try:
                    found = list(score(part.to_dict("records")))
                except Exception:  # a failed batch is a batch of nulls
                    found, failed = [], True
                found += [None] * (len(part) - len(found))
                rows = [[f.get(n) if isinstance(f, dict) else None for n in names] for f in found[: len(part)]]
                out = pd.DataFrame(rows, columns=names, dtype=object)
                out.insert(0, "id", part["id"].to_numpy())
                out["failed"] = failed
                yield out

    return df.select("id", *(c for c in columns if c != "id")).mapInPandas(run, f"id long, {schema}, failed boolean")


def merge_classes(products: DataFrame, results: DataFrame) -> DataFrame:
    """K1: feed, subniche and tags that were given; others stay."""
    own = results.select("id", F.col("is_fashion").alias("_f"), F.col("subniche").alias("_s"), F.col("tags").alias("_t"))
    return products.join(own, "id", "left").withColumns({"is_fashion": F.coalesce("_f", "is_fashion"), "subniche": F.coalesce("_s", "subniche"), "ai_tags": F.coalesce("_t", "ai_tags")}).drop("_f", "_s", "_t")


def unclassified(results: DataFrame, group: str = "store_id") -> DataFrame:
    """K3: rows with a class; a group without any is ``failed`` as a whole."""
    some = results.groupBy(group).agg(F.count_if(F.col("is_fashion").isNotNull()).alias("_some"))
    joined = results.join(some, group).withColumn("status", F.when(F.col("is_fashion").isNotNull(), "kept").when(F.col("_some") == 0, "failed").otherwise("dropped"))
    return joined.drop("_some")


def without_model(items: DataFrame, tables: Tables = SAMPLE) -> DataFrame:
    """K4: with no model every row that survives the junk filter is fashion."""
    return items.where(~is_junk(items, tables.junk)).withColumn("is_fashion", F.lit(True))


def reclassify_general(products: DataFrame, results: DataFrame, dry_run: bool, tables: Tables = SAMPLE) -> DataFrame:
    """K5: general rows that aren't junk and are flagged as wearable, promoted unless it's a dry run."""
    flagged = results.where("wearable").select("id")
    hit = products.where(in_feed(False) & ~is_junk(products, tables.junk)).join(flagged, "id", "left_semi")
    return hit if dry_run else promoted(hit, F.lit(True))


def merge_vision(products: DataFrame, results: DataFrame, *, now: str) -> DataFrame:
    """K6: image tags before the old ones, description and time; a row that shows no product is retired."""
    own = results.select("id", *(F.col(c).alias(f"_{c}") for c in ("kind", "gender", "colors", "attributes", "description", "is_product")))
    both, given = products.join(own, "id", "left"), F.col("_is_product").isNotNull()
    text = F.regexp_replace(F.coalesce("ai_tags", F.lit("")), r"^img:.*?(\|\| |$)", "")
    none = F.lit("")
    tags = render_tags(F.col("_kind"), F.col("_gender"), none, F.col("_colors"), none, none, F.col("_attributes"), text)
    out = F.col("_is_product") == F.lit(False)
    return both.withColumns({
        "ai_tags": F.when(given, tags).otherwise(F.col("ai_tags")), "vision_description": F.col("_description"),
        "vision_classified_at": F.when(given, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("vision_classified_at")),
        "is_fashion": F.when(out, False).otherwise(F.col("is_fashion")), "subniche": F.when(out, "").otherwise(F.col("subniche")),
    }).select(*products.columns, "vision_description")


def verdicts(candidates: DataFrame, judged: DataFrame) -> DataFrame:
    """Candidates with verdict ``match``; the first verdict of an id counts, a missing one drops, a failed batch keeps."""
    first = judged.groupBy("id").agg(F.min_by("match", "seq").alias("match"), F.min_by("failed", "seq").alias("failed"))
    return candidates.join(first, "id", "left").where(F.coalesce("failed", F.lit(False)) | F.coalesce("match", F.lit(False))).drop("match", "failed")


def run_summary(counts: DataFrame) -> DataFrame:
    """Totals of a run; a store with an empty result has failed."""
    n = F.col("fashion_count") + F.col("general_count")
    return counts.agg(F.count("*").alias("stores"), F.count_if(n > 0).alias("stores_ok"), F.count_if(n == 0).alias("stores_failed"), F.sum("fashion_count").alias("fashion"), F.sum("general_count").alias("general"))


def error_summary(failures: DataFrame, group: str = "store_id") -> DataFrame:
    """Per group how many rows failed, three distinct messages and five titles, all in order.

    Ranks are cut before anything is gathered, so no group's list can grow.
    """
    n = failures.groupBy(group).agg(F.count("*").alias("missing"))
    distinct = failures.groupBy(group, "message").agg(F.min("id").alias("_at"))
    messages = distinct.withColumn("_n", F.expr(f"row_number() OVER (PARTITION BY {group} ORDER BY _at)")).where("_n <= 3").groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "message"))), lambda x: x.message), "; ").alias("messages"))
    sample = failures.withColumn("_n", F.expr(f"row_number() OVER (PARTITION BY {group} ORDER BY id)")).where("_n <= 5").groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "title"))), lambda x: x.title), "; ").alias("sample"))
    return n.join(messages, group).join(sample, group)
