"""Rank movement: priors, labels, the event ledger."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sides import merged

CAP, SHARE, RETENTION_DAYS = 30, 0.30, 30


def day(now: str) -> Column:
    return F.to_date(F.lit(now[:10]))


def threshold(size: Column) -> Column:
    """H1: largest believable move in a catalog of ``size``."""
    return F.when(size <= 0, CAP).otherwise(F.least(F.lit(CAP), F.greatest(F.lit(1), F.floor(F.lit(SHARE) * size).cast("int"))))


def trusted(now: str, epoch: str, start: str) -> Column:
    """H8: a snapshot of another day, at or after both floors."""
    date = F.col("date")
    return (F.to_date(date) < day(now)) & (date >= F.lit(epoch).cast("timestamp_ntz")) & (date >= F.lit(start).cast("timestamp_ntz"))


def prior_positions(history: DataFrame, *, now: str, epoch: str, start: str) -> DataFrame:
    """The last trusted snapshot of each product; partial aggregation, no window."""
    return history.where(trusted(now, epoch, start)).groupBy(F.col("product_id").alias("id")).agg(F.max_by("position", F.struct("date", "id")).alias("prior"))


def catalog_sizes(products: DataFrame) -> DataFrame:
    """Rows per store and feed; general ones need a subniche."""
    return products.groupBy("store_id", "is_fashion").agg(F.count_if(F.col("is_fashion") | (F.col("subniche") != "")).alias("size"))


def labels_from_priors(own: DataFrame, priors: DataFrame, sizes: DataFrame) -> DataFrame:
    """H2 for rows whose prior positions (``id, prior``) and catalog sizes are known."""
    known = own.join(merged(priors.select("id", "prior")), "id", "left").join(sizes, ["store_id", "is_fashion"], "left")
    prior, at = F.col("prior"), F.coalesce("current_position", F.lit(0))
    none = F.coalesce(prior, F.lit(0)) == 0
    far = F.abs(prior - at) > threshold(F.coalesce("size", F.lit(0)))
    label = F.when(none, "new").when((prior == at) | far, "normal").when(at < prior, "hero").otherwise("villain")
    return known.withColumns({"label": label, "position_change": F.when(none | far, 0).otherwise(prior - at), "prior_position": F.coalesce(prior, F.lit(0))}).drop("prior", "size")


def movement_labels(products: DataFrame, history: DataFrame, *, now: str, epoch: str, start: str, among: DataFrame | None = None) -> DataFrame:
    """Products, or those of the ids ``among``, with ``label, position_change, prior_position``."""
    own = products if among is None else products.join(among.select("id"), "id", "left_semi")
    return labels_from_priors(own, prior_positions(history, now=now, epoch=epoch, start=start), catalog_sizes(products))


def label_filter(labelled: DataFrame, label: str) -> DataFrame:
    """H9: as the feeds show labels; ``normal`` keeps equal ranks only."""
    kept = labelled.where(F.col("label") == label)
    return kept.where("prior_position = current_position") if label == "normal" else kept


def events_of(labelled: DataFrame, *, now: str, epoch: str) -> DataFrame:
    """H3: the hero and villain rows among labelled products, as events of today. None at all if the epoch isn't before today."""
    if dt.date.fromisoformat(epoch[:10]) >= dt.date.fromisoformat(now[:10]):
        labelled = labelled.where("false")
    found = labelled.where("label IN ('hero', 'villain') AND current_position <> 0")
    return found.select("store_id", F.col("id").alias("product_id"), day(now).alias("date"), "label", "prior_position", "current_position", "position_change")


def events_of_today(products: DataFrame, history: DataFrame, *, now: str, epoch: str, start: str) -> DataFrame:
    """H3: today's events by the whole history."""
    return events_of(movement_labels(products, history, now=now, epoch=epoch, start=start), now=now, epoch=epoch)


def merge_events(ledger: DataFrame, fresh: DataFrame) -> DataFrame:
    """H3: next ledger; a fresh row replaces that of its product and day, no row is removed."""
    return ledger.join(merged(fresh.select("product_id", "date")), ["product_id", "date"], "left_anti").select(*ledger.columns).unionByName(fresh)


def daily_last(history: DataFrame) -> DataFrame:
    """A product's last snapshot of each day."""
    return history.groupBy("product_id", F.to_date("date").alias("date")).agg(F.max_by("position", F.struct("date", "id")).alias("position"))


def observed_steps(daily: DataFrame) -> DataFrame:
    """Each observed day with the one before, however long ago."""
    return daily.withColumn("prior_position", F.expr("lag(position) OVER (PARTITION BY product_id ORDER BY date)"))


def backfill_events(products: DataFrame, history: DataFrame, ledger: DataFrame | None, *, now: str, start: str, retention: int = RETENTION_DAYS) -> DataFrame:
    """Events of the past days that the ledger doesn't have."""
    low = F.greatest(F.date_sub(day(now), retention), F.to_date(F.lit(start[:10])))
    days = daily_last(history.where((F.to_date("date") >= low) & (F.to_date("date") < day(now))))
    steps = observed_steps(days).where("prior_position IS NOT NULL AND prior_position <> 0 AND position <> 0 AND position <> prior_position")
    owned = steps.join(merged(products.select(F.col("id").alias("product_id"), "store_id", "is_fashion")), "product_id").join(catalog_sizes(products), ["store_id", "is_fashion"], "left")
    change = F.col("prior_position") - F.col("position")
    events = owned.where(F.abs(change) <= threshold(F.coalesce("size", F.lit(0)))).select(
        "store_id", "product_id", "date", F.when(change > 0, "hero").otherwise("villain").alias("label"), "prior_position", F.col("position").alias("current_position"), change.alias("position_change"))
    return events if ledger is None else events.join(merged(ledger.select("product_id", "date")), ["product_id", "date"], "left_anti")


def keep_recent(rows: DataFrame, *, now: str, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows dated at or after ``now`` less ``days``, the time of day included.

    Of a table partitioned by ``day`` older partitions aren't read.
    """
    if "day" in rows.columns:
        rows = rows.where(F.col("day") >= F.date_sub(day(now), days))
    return rows.where(F.col("date").cast("timestamp_ntz") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))


def drop_before(rows: DataFrame, start: str) -> DataFrame:
    """H6: rows at or after the floor."""
    return rows.where(F.col("date").cast("timestamp_ntz") >= F.lit(start).cast("timestamp_ntz"))


def event_window(ledger: DataFrame, products: DataFrame, *, label: str, days: int, now: str, start: str, is_fashion: bool | None = None, store_id: int | None = None) -> DataFrame:
    """The newest event of a label per product in the last ``days`` days.

    A label other than hero and villain gives nothing; no feed gives all products,
    retired ones too.
    """
    low = F.greatest(F.date_sub(day(now), days - 1), F.to_date(F.lit(start[:10])))
    own = ledger.where((F.col("label") == label) & (F.col("date") >= low))
    if label not in ("hero", "villain"):
        own = own.where("false")
    if store_id is not None:
        own = own.where(F.col("store_id") == store_id)
    newest = own.groupBy("product_id").agg(F.max_by(F.struct("date", "label", "prior_position", F.col("current_position").alias("event_position"), "position_change"), "date").alias("e")).select("product_id", "e.*")
    feed = F.lit(True) if is_fashion is None else F.col("is_fashion") if is_fashion else ~F.col("is_fashion") & (F.col("subniche") != "")
    return newest.join(merged(products.where(feed)), F.col("product_id") == F.col("id"))
