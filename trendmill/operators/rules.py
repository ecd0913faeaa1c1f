"""Routing rules: junk, forced feeds, subniches, categories, quotas.

The pattern tables are arguments with small defaults; order is precedence. All
patterns are matched with Unicode case and word borders (``(?iU)``).
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_or_empty

WEARABLE = ("fashion", "bags", "accessories", "jewelry")
GENERAL = ("electronics", "home", "beauty", "health", "food", "toys-books", "other")
JUNK = {"title": r"\b(gift card|shipping protection|warranty|anvil)\b", "product_type": r"\b(insurance|donation)\b", "url": r"gift-?card|shipping-protection"}
FORCE_GENERAL = r"\b(smartwatch|lamp|gear|gizmo|hängelampe|überraschungsbox)\b"
FORCE_FASHION = r"\b(dress|sneakers?|ring|rod|red widget)\b"
SUBNICHES = (("electronics", r"\b(gizmo|charger|smartwatch)\b"), ("home", r"\b(plate|lamp|hängelampe)\b"), ("beauty", r"\b(serum|mascara)\b"), ("health", r"\b(posture|massage)\b"), ("food", r"\b(coffee|snack)\b"), ("toys-books", r"\b(puzzle|toy|gear)\b"))
CATEGORIES = (("smartwatch", "electronics", r"\bsmart\s*watch(es)?\b"), ("watch", "accessories", r"\bwatch(es)?\b"), ("ring", "jewelry", r"\brings?\b"), ("bolt", "hardware", r"\bbolts?\b"), ("gear", "hardware", r"\bgears?\b|\banvils?\b"), ("plate", "home", r"\bplates?\b"), ("red-widget", "home", r"\bred widgets?\b"), ("widget", "home", r"\bwidgets?\b"))


PHRASES = (("smartwatch", "electronics", ("smartwatch", "smartwatches", "smart watch", "smart watches")), ("watch", "accessories", ("watch", "watches")), ("ring", "jewelry", ("ring", "rings")), ("bolt", "hardware", ("bolt", "bolts")), ("gear", "hardware", ("gear", "gears", "anvil", "anvils")), ("plate", "home", ("plate", "plates")), ("red-widget", "home", ("red widget", "red widgets")), ("widget", "home", ("widget", "widgets")))


class Tables(NamedTuple):
    """The rule tables of a user; all are patterns or ordered (name, pattern) entries."""

    junk: dict[str, str] = JUNK
    general: str = FORCE_GENERAL
    fashion: str = FORCE_FASHION
    subniches: tuple[tuple[str, str], ...] = SUBNICHES
    catalog: tuple[tuple[str, str, str], ...] = CATEGORIES


SAMPLE = Tables()
FIELDS = ("title", "product_type", "handle", "product_url", "image_url")


def hits(c: Column, pattern: str) -> Column:
    return text_or_empty(c).rlike(f"(?iU){pattern}")


def any_field(df: DataFrame, pattern: str, fields: tuple[str, ...] = FIELDS) -> Column:
    return reduce(lambda a, b: a | b, (hits(F.col(f), pattern) for f in fields if f in df.columns))


def is_junk(df: DataFrame, patterns: dict[str, str] = JUNK) -> Column:
    """Title, type or address say that this is no product."""
    return hits(F.col("title"), patterns["title"]) | hits(F.col("product_type"), patterns["product_type"]) | any_field(df, patterns["url"], ("handle", "product_url", "image_url"))


def forced_general(df: DataFrame, pattern: str = FORCE_GENERAL) -> Column:
    """B9"""
    return any_field(df, pattern)


def forced_fashion(df: DataFrame, pattern: str = FORCE_FASHION) -> Column:
    """B10"""
    return any_field(df, pattern)


def general_subniche(title: Column, table=SUBNICHES) -> Column:
    """First matching entry, else ``other``."""
    return F.coalesce(*(F.when(hits(title, p), name) for name, p in table), F.lit("other"))


def assign_category(df: DataFrame, catalog=CATEGORIES) -> Column:
    """First category in catalog order over the four fields, else blank."""
    text = F.concat_ws(" ", *(text_or_empty(F.col(f)) for f in ("title", "handle", "image_url", "product_type")))
    return F.coalesce(*(F.when(hits(text, p), name) for name, _, p in catalog), F.lit(""))


TOKEN = r"[\w']+"


def phrase_categories(df: DataFrame, catalog: tuple[tuple[str, str, tuple[str, ...]], ...] = PHRASES, fields: tuple[str, ...] = ("title", "handle", "image_url", "product_type")) -> Column:
    """B12 for catalogs of many literal phrases, ``(category, parent, phrases)``: the first category in order, else blank.

    A phrase matches whole words in any case, with anything but a word between them.
    All phrases are sought in one pass over a row's words: a dictionary leads from a
    first word to the phrases that begin with it, so time doesn't grow with their
    number. Patterns that aren't phrases go with ``assign_category``.
    """
    words = re.compile(TOKEN)
    begins: dict[str, list[tuple[tuple[str, ...], int]]] = {}
    for place, (_, _, phrases) in enumerate(catalog):
        for phrase in phrases:
            own = tuple(words.findall(phrase.lower()))
            if own:
                begins.setdefault(own[0], []).append((own, place))
    names = [name for name, _, _ in catalog]

    def category(text: str | None) -> str:
        own, best = words.findall((text or "").lower()), len(names)
        for at, word in enumerate(own):
            for phrase, place in begins.get(word, ()):
                if place < best and tuple(own[at : at + len(phrase)]) == phrase:
                    best = place
        return names[best] if best < len(names) else ""

    @F.arrow_udf("string")
    def named(texts: pa.Array) -> pa.Array:
        return pa.array([category(t) for t in texts.to_pylist()], pa.string())

    return named(F.concat_ws(" ", *(text_or_empty(F.col(f)) for f in fields)))


def route(items: DataFrame, tables: Tables = SAMPLE) -> DataFrame:
    """Drops junk and ``exclude``; sets ``is_fashion`` and ``subniche``. Function beats form."""
    own = items.where(~is_junk(items, tables.junk)).withColumn("_sub", F.lower(F.trim(text_or_empty(F.col("subniche"))))).where("_sub <> 'exclude'")
    wearable, general = F.col("_sub").isin(*WEARABLE), forced_general(own, tables.general)
    fashion = ~general & forced_fashion(own, tables.fashion)
    sub = F.when(general & (wearable | (F.col("_sub") == "")), general_subniche(F.col("title"), tables.subniches)).when(fashion & ~wearable, "fashion").otherwise(F.col("subniche"))
    feed = F.when(general, False).when(fashion | wearable, True).otherwise(F.coalesce("is_fashion", F.lit(False)))
    return own.withColumns({"is_fashion": feed, "subniche": sub}).drop("_sub")


def sane_subniche(is_fashion: Column, subniche: Column) -> Column:
    """Subniches that a feed doesn't know become its default."""
    sub = F.lower(F.trim(text_or_empty(subniche)))
    return F.when(is_fashion, F.when(sub.isin(*WEARABLE), sub).otherwise("fashion")).otherwise(F.when(sub.isin(*GENERAL), sub).otherwise("other"))


def first_per_store(items: DataFrame) -> DataFrame:
    """The first (page, slot) of each handle in a store."""
    return items.withColumn("_n", F.expr("row_number() OVER (PARTITION BY store_id, handle ORDER BY page_id, slot)")).where("_n = 1").drop("_n")


def source_positions(items: DataFrame, cap: int = 600) -> DataFrame:
    """Running place over a store's pages, junk included, up to ``cap``."""
    return items.withColumn("source_position", F.expr("row_number() OVER (PARTITION BY store_id ORDER BY page_id, slot)")).where(F.col("source_position") <= cap)


def feed_quota(items: DataFrame, target: int = 200) -> DataFrame:
    """The first ``target`` items per store and feed; places stay."""
    return items.withColumn("_n", F.expr("row_number() OVER (PARTITION BY store_id, is_fashion ORDER BY source_position)")).where(F.col("_n") <= target).drop("_n")
