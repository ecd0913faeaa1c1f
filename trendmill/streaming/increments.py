"""Runs applied one after the other, from small states instead of the history.

A product's progress is its last observed day with the last position on it, and the
position of the observed day before. That is all that a run's events need, so a run
reads the products, their progress and its own rows, however long the history is.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators import rules as R
from ..operators import state as S
from ..operators.commits import Commit, committed, newest_commit, write_commit, write_part
from ..operators.sides import checked

PROGRESS = "product_id long, day date, date timestamp_ntz, position int, before int"
EVENTS = ("store_id", "product_id", "date", "label", "prior_position", "current_position", "position_change")


class Rules(NamedTuple):
    """What runs share: floors of trust, limits and rule tables."""

    epoch: str
    start: str
    cap: int = 600
    guard: int = 5
    tables: R.Tables = R.SAMPLE


def progress_of(history: DataFrame, *, epoch: str, start: str) -> DataFrame:
    """Each product's progress by a whole history of trusted snapshots, for the first run."""
    trusted = history.where((F.col("date") >= F.lit(epoch).cast("timestamp_ntz")) & (F.col("date") >= F.lit(start).cast("timestamp_ntz")))
    days = trusted.groupBy("product_id", F.to_date("date").alias("day")).agg(F.max(F.struct("date", "id", "position")).alias("last"))
    two = days.withColumn("n", F.expr("row_number() OVER (PARTITION BY product_id ORDER BY day DESC)")).where("n <= 2")
    pick = lambda n, c: F.max(F.when(F.col("n") == n, F.col(c)))
    return two.groupBy("product_id").agg(pick(1, "day").alias("day"), pick(1, "last.date").alias("date"), pick(1, "last.position").alias("position"), pick(2, "last.position").alias("before"))


def advanced(progress: DataFrame, snapshots: DataFrame, *, epoch: str, start: str) -> DataFrame:
    """Progress after a run's snapshots, one per product; those of an earlier day or time than known, or untrusted, change nothing."""
    trusted = (F.col("date") >= F.lit(epoch).cast("timestamp_ntz")) & (F.col("date") >= F.lit(start).cast("timestamp_ntz"))
    fresh = snapshots.where(trusted).select("product_id", F.to_date("date").alias("_day"), F.col("date").alias("_date"), F.col("position").alias("_position"))
    both = progress.join(fresh, "product_id", "full_outer")
    later = F.col("_date").isNotNull() & (F.col("day").isNull() | (F.col("_date") >= F.col("date")))
    new_day = later & (F.col("_day") > F.col("day"))
    pick = lambda c: F.when(later, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return both.select("product_id", pick("day"), pick("date"), pick("position"), F.when(new_day, F.col("position")).otherwise(F.col("before")).alias("before"))


def priors_at(progress: DataFrame, now: str) -> DataFrame:
    """``id, prior``: the last position of the last observed day before that of ``now``."""
    today = L.day(now)
    prior = F.when(F.col("day") < today, F.col("position")).when(F.col("day") == today, F.col("before"))
    return progress.select(F.col("product_id").alias("id"), prior.alias("prior"))


def apply_increment(products: DataFrame, progress: DataFrame, scraped: DataFrame, *, now: str, rules: Rules) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """G3, A8, H3 for one run of some stores: next products, snapshots, events, next progress. Other stores' rows pass as they are."""
    stores = checked(scraped.select("store_id").distinct())
    state = S.apply_scrape(products.join(stores, "store_id", "left_semi"), scraped, now=now, cap=rules.cap, guard=rules.guard, tables=rules.tables)
    snapshots = S.append_history(state, now=now)
    labelled = L.labels_from_priors(state, priors_at(progress, now), L.catalog_sizes(state))
    events = L.events_of(labelled, now=now, epoch=rules.epoch)
    after = products.join(stores, "store_id", "left_anti").unionByName(state.drop("listed"))
    return after, snapshots, events, advanced(progress, snapshots, epoch=rules.epoch, start=rules.start)


def begin(spark: SparkSession, path: str, products: DataFrame, progress: DataFrame | None = None) -> None:
    """The first commit: products, and the progress of an older history if there is one."""
    write_part(products, path, "products", "first")
    write_part(spark.createDataFrame([], PROGRESS) if progress is None else progress, path, "progress", "first")
    write_commit(spark, path, Commit(-1, {"products": ["first"], "progress": ["first"]}))


def run_name(batch_id: int, k: int) -> str:
    """Names that sort as the runs followed each other."""
    return f"b{batch_id:012d}-{k:06d}"


def apply_batches(path: str, rules: Rules) -> Callable[[DataFrame, int], None]:
    """L1: the function for ``foreachBatch``. A batch's runs (distinct ``date``) are applied in their order and committed together.

    Rows are a scrape's: ``store_id``, the product's attributes, ``date`` of the run. A
    batch starts from the commit before it, and its parts are named by it, so a
    repeated batch writes the same parts again. It reads no history and no ledger.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = newest_commit(spark, path, before=batch_id)
        if last is None:
            raise ValueError("the tables have no first commit")
        runs = [r["at"] for r in batch.select(F.date_format("date", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")).distinct().orderBy("at").collect()]  # one row per run
        for k, now in enumerate(runs):
            name = run_name(batch_id, k)
            products, progress = (committed(spark, path, last, t).drop("run") for t in ("products", "progress"))
            scraped = batch.where(F.date_format("date", "yyyy-MM-dd HH:mm:ss.SSSSSS") == now).drop("date")
            after, snapshots, events, further = apply_increment(products, progress, scraped, now=now, rules=rules)
            write_part(after, path, "products", name)
            S.write_history(snapshots, f"{path}/history", name)
            write_part(events, path, "ledger", name)
            write_part(further, path, "progress", name)
            last = last.with_parts(batch_id, {"history": name, "ledger": name}, {"products": name, "progress": name})
        if runs:
            write_commit(spark, path, last)

    return apply


def ledger_of(parts: DataFrame) -> DataFrame:
    """The ledger of all runs' events: of a product's events of one day the last run's stands (H3)."""
    rest = [c for c in EVENTS if c not in ("product_id", "date")]
    return parts.groupBy("product_id", "date").agg(F.max_by(F.struct(*rest), "run").alias("_e")).select("product_id", "date", "_e.*").select(*EVENTS)


def table_of(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame | None:
    """``products``, ``progress``, ``history`` or ``ledger`` as of the newest commit, or that of a version."""
    commit = newest_commit(spark, path, None if version is None else version + 1)
    own = commit and committed(spark, path, commit, name)
    return None if own is None else ledger_of(own) if name == "ledger" else own.drop("run")
