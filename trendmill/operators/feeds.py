"""Feeds, cards, sorts and statistics over the four tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import expects_both, text_or_empty, visitors
from . import labels as L

CARD = ("id", "title", "handle", "image_url", "price", "vendor", "product_type", "current_position", "ai_tags", "subniche", "product_category", "is_fashion", "store_id", "store_name", "store_url", "niche", "label", "position_change", "prior_position")


def in_feed(is_fashion: bool) -> Column:
    """B3"""
    return F.col("is_fashion") if is_fashion else ~F.col("is_fashion") & (F.col("subniche") != "")


def with_store(products: DataFrame, stores: DataFrame) -> DataFrame:
    """Each product with its store's columns. The planner broadcasts stores if they are small."""
    own = stores.select(F.col("id").alias("store_id"), F.col("name").alias("store_name"), F.col("url").alias("store_url"), "niche", "monthly_visitors")
    return products.join(own, "store_id")


def cards(products: DataFrame) -> DataFrame:
    """B1: output fields; missing tags are blank, a missing label is ``new, 0, 0``."""
    for name, default in (("label", F.lit("new")), ("position_change", F.lit(0)), ("prior_position", F.lit(0))):
        products = products.withColumn(name, F.coalesce(name, default) if name in products.columns else default)
    return products.withColumn("ai_tags", text_or_empty(F.col("ai_tags"))).select(*CARD)


def event_cards(events: DataFrame, stores: DataFrame, is_fashion: bool) -> DataFrame:
    """B2: cards of event rows, their day, and whether the product is still in the feed."""
    own = with_store(events, stores).withColumns({"event_date": F.col("date"), "is_active": in_feed(is_fashion)})
    return own.withColumn("ai_tags", text_or_empty(F.col("ai_tags"))).select(*CARD, "event_date", "is_active")


def sort_limit(products: DataFrame, sort: str, limit: int) -> DataFrame:
    """``high-low`` is best rank first, ``low-high`` the reverse, ``volume`` by visitors."""
    at = F.coalesce("current_position", F.lit(0))
    keys = {"high-low": [at.asc()], "low-high": [at.desc()], "volume": [visitors(F.col("monthly_visitors")).desc(), at.asc()]}[sort]
    return products.orderBy(*keys, F.col("id").asc()).limit(max(1, min(limit, 500)))


def feed(stores: DataFrame, products: DataFrame, history: DataFrame, ledger: DataFrame, *, is_fashion: bool, label: str | None, sort: str, limit: int, now: str, epoch: str, start: str, days: int = 7, store_id: int | None = None, matching: DataFrame | None = None) -> DataFrame:
    """A combined or store feed as cards.

    Hero and villain of combined feeds come from the ledger. Without a label the
    page is cut first and only its rows are labelled, from their own snapshots; with
    one all rows are labelled, filtered and then cut. ``matching`` (ids) restricts to search hits.
    """
    scope = products if store_id is None else products.where(F.col("store_id") == store_id)
    if matching is not None:
        scope = scope.join(matching.select("id"), "id", "left_semi")
    if store_id is None and label in ("hero", "villain"):
        events = L.event_window(ledger, scope, label=label, days=days, now=now, start=start, is_fashion=is_fashion)
        page = sort_limit(with_store(events, stores).drop("store_name", "store_url", "niche"), sort, limit)
        return event_cards(page.drop("monthly_visitors"), stores, is_fashion)
    own = with_store(scope.where(in_feed(is_fashion)), stores)
    floors = {"now": now, "epoch": epoch, "start": start}
    sizes_of = products.select("id", "store_id", "is_fashion", "subniche", "current_position")
    if label is None:
        page = sort_limit(own, sort, limit)
        shown = F.broadcast(page.select("id"))  # at most 500 rows
        past = history.join(shown.withColumnRenamed("id", "product_id"), "product_id", "left_semi")
        labels = L.movement_labels(sizes_of, past, **floors, among=shown).select("id", "label", "position_change", "prior_position")
        return cards(page.join(labels, "id", "left"))
    labels = L.label_filter(L.movement_labels(sizes_of, history, **floors), label).select("id", "label", "position_change", "prior_position")
    return cards(sort_limit(own.join(labels, "id"), sort, limit))


def store_counts(stores: DataFrame, products: DataFrame) -> DataFrame:
    """Feed counts and last scrape of every store; zero without products."""
    counts = products.groupBy("store_id").agg(F.count_if(in_feed(True)).alias("fashion_count"), F.count_if(in_feed(False)).alias("general_count"), F.max("last_scraped").alias("last_scraped"))
    joined = stores.join(counts, stores.id == counts.store_id, "left")
    return joined.select("id", "name", "niche", F.coalesce("fashion_count", F.lit(0)).alias("fashion_count"), F.coalesce("general_count", F.lit(0)).alias("general_count"), "last_scraped")


def unhealthy_stores(counts: DataFrame, skew: int = 100) -> DataFrame:
    """Dead stores, and stores with over ``skew`` rows in one feed and none in the other they should fill."""
    f, g = F.col("fashion_count"), F.col("general_count")
    status = F.when((f == 0) & (g == 0), "dead").when(expects_both(F.col("niche")) & (((f > skew) & (g == 0)) | ((g > skew) & (f == 0))), "skewed")
    return counts.withColumn("status", status).where("status IS NOT NULL").select("id", "name", "status", "fashion_count", "general_count")


def statistics(stores: DataFrame, products: DataFrame, ledger: DataFrame, *, days: int, is_fashion: bool, now: str, start: str) -> DataFrame:
    """D3: one row of totals; the ledger is read once, crossed frames have one row each."""
    low = F.greatest(F.date_sub(L.day(now), days - 1), F.to_date(F.lit(start[:10])))
    moved = ledger.where(F.col("date") >= low).groupBy("product_id").agg(F.bool_or(F.col("label") == "hero").alias("hero"), F.bool_or(F.col("label") == "villain").alias("villain"))
    own = products.where(in_feed(is_fashion)).select("id").join(moved, F.col("id") == F.col("product_id"), "left")
    totals = own.agg(F.count("*").alias("products"), F.count_if(F.col("hero")).alias("heroes"), F.count_if(F.col("villain")).alias("villains"))
    return stores.agg(F.count("*").alias("stores")).crossJoin(totals)


def snapshot_histogram(history: DataFrame, products: DataFrame, stores: DataFrame, *, now: str, days: int = 5) -> DataFrame:
    """Snapshots per store and day of the last days."""
    own = history.where(F.to_date("date") > F.date_sub(L.day(now), days)).select("product_id", "date")
    named = own.join(products.select(F.col("id").alias("product_id"), "store_id"), "product_id").join(stores.select(F.col("id").alias("store_id"), "name"), "store_id")
    return named.groupBy("store_id", "name", F.to_date("date").alias("date")).agg(F.count("*").alias("snapshots"))


def delta_summary(labelled: DataFrame, cap: int = L.CAP) -> DataFrame:
    """Order statistics are the values at index n/2 and 0.9 n of the ascending moves."""
    moves = labelled.where("prior_position > 0").select((F.col("prior_position") - F.col("current_position")).alias("d")).withColumn("a", F.abs("d"))
    counts = moves.groupBy("a").agg(F.count("*").alias("c"))  # one row per distinct move
    total = moves.agg(F.count("*").alias("n"), F.min("a").alias("abs_min"), F.max("a").alias("abs_max"), F.count_if(F.col("a") <= cap).alias("within_cap"), F.count_if(F.col("a") > cap).alias("over_cap"),
                      F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"), F.count_if(F.col("d") == 0).alias("same"))
    placed = counts.withColumn("upto", F.expr("sum(c) OVER (ORDER BY a)")).crossJoin(total.select("n"))
    at = placed.agg(F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("a"))).alias("abs_median"), F.min(F.when(F.col("upto") > F.floor(F.col("n") * 0.9), F.col("a"))).alias("abs_p90"))
    return total.crossJoin(at)


def event_windows(ledger: DataFrame, *, now: str, start: str) -> DataFrame:
    """Totals by window, oldest and newest."""
    since = lambda n: F.count_if(F.col("date") >= F.date_sub(L.day(now), n - 1)).alias(f"last_{n}")
    return ledger.agg(F.count("*").alias("total"), F.count_if(F.col("date") < F.to_date(F.lit(start[:10]))).alias("before_start"), since(7), since(14), since(30), F.min("date").alias("oldest"), F.max("date").alias("newest"))


def events_per_day(ledger: DataFrame) -> DataFrame:
    """D9"""
    return ledger.groupBy("date", "label").agg(F.count("*").alias("events"))


def embedding_coverage(products: DataFrame) -> DataFrame:
    """D10"""
    own = products.agg(F.count("*").alias("total"), F.count("embedding").alias("with_vector"))
    return own.withColumn("pct", F.when(F.col("total") > 0, F.round(100.0 * F.col("with_vector") / F.col("total"), 1)).otherwise(0.0))


def labels_today(labelled: DataFrame, cap: int = L.CAP) -> DataFrame:
    """Fashion movers under the absolute cap alone."""
    move = F.col("prior_position") - F.col("current_position")
    near = F.col("is_fashion") & (F.col("prior_position") > 0) & (F.abs(move) <= cap)
    return labelled.agg(F.count_if(near & (move > 0)).alias("heroes"), F.count_if(near & (move < 0)).alias("villains"))


def movement_diagnostics(labelled: DataFrame, stores: DataFrame, products: DataFrame, history: DataFrame, ledger: DataFrame, *, now: str, start: str, movers: int = 10) -> DataFrame:
    """D5-D9, D15 and the largest movers as one table ``section, name, value``.

    Names are ``store/day``, ``day/label`` or ``place/product`` where a section has
    many rows, else the measure. Days as values count from 1970; a measure that is
    unknown has no row.
    """
    named = lambda section, rows, value, *parts: rows.select(F.lit(section).alias("section"), F.concat_ws("/", *(F.col(c).cast("string") for c in parts)).alias("name"), F.col(value).cast("long").alias("value"))
    measures = lambda section, row: row.select(*(F.col(c).cast("long") for c in row.columns)).unpivot([], row.columns, "name", "value").select(F.lit(section).alias("section"), "name", "value").where("value IS NOT NULL")
    windows = event_windows(ledger, now=now, start=start).withColumns({c: F.unix_date(c) for c in ("oldest", "newest")})
    moved = labelled.where("label IN ('hero', 'villain')").orderBy(F.abs("position_change").desc(), "id").limit(movers)
    placed = moved.withColumn("place", F.expr("row_number() OVER (ORDER BY abs(position_change) DESC, id)"))  # at most ``movers`` rows
    parts = [
        named("snapshots", snapshot_histogram(history, products, stores, now=now), "snapshots", "store_id", "date"),
        measures("moves", delta_summary(labelled)),
        measures("ledger", windows),
        named("events", events_per_day(ledger), "events", "date", "label"),
        measures("today", labels_today(labelled)),
        named("movers", placed, "position_change", "place", "id"),
    ]
    return reduce(DataFrame.unionByName, parts)
