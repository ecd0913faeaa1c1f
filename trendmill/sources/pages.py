"""Products out of stored collection pages."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BADGE
from .model import saved

SHOP = r"://([^/]+)"
VARIANTS = "array<struct<price:struct<amount:double>,image:struct<src:string>,product:struct<id:string,title:string,untranslatedTitle:string,url:string,vendor:string,type:string>>>"
ITEMS = "page_id long, store_id string, slot int, handle string, title string, price string, vendor string, product_type string, image_url string, product_url string"
#: What tells product links, cards, titles and prices of a shop's page.
LINK = r"(?:^|/)products/([A-Za-z0-9][A-Za-z0-9_-]*)(?=[/?#]|$)"
CARD_CLASS = re.compile(r"product|grid__item|card|tile|item", re.I)
TITLE_CLASS = re.compile(r"title|product-?name|product-?heading", re.I)
PRICE_CLASS = re.compile(r"price|money|amount", re.I)
BADGE_CLASS = re.compile(r"badge|label|percent|saving|save|discount|sale-", re.I)
PRICE, WHOLE_PRICE = re.compile(r"\d{1,3}[.,]\d{2}"), re.compile(r"\d{2,}")
VARIANT = re.compile(r'\s*[\[{].*"id"\s*:\s*\d', re.S)
STEPS_UP = 6


def main_region(html: Column) -> Column:
    """What stands in a page's ``main`` element, or the whole page without one."""
    inner = F.regexp_extract(html, r"(?is)<main\b[^>]*+>(.*)</main\s*+>", 1)
    return F.when(inner != "", inner).otherwise(html)


def link_items(pages: DataFrame, pattern: str = r'<a\s[^>]*?href="(?:[^"]*/)?products/([A-Za-z0-9][A-Za-z0-9_-]*)(?=["/?#])') -> DataFrame:
    """A3, plain links: ``page_id, store_id (host), slot, handle`` of every match of ``pattern`` in a page's main region."""
    found = pages.select("page_id", F.regexp_extract("url", SHOP, 1).alias("store_id"), F.posexplode(F.regexp_extract_all(main_region(F.col("html")), F.lit(pattern), 1)).alias("slot", "handle"))
    return found.select("page_id", "store_id", (F.col("slot") + 1).alias("slot"), F.lower("handle").alias("handle"))


def viewed_items(html: Column) -> Column:
    """A2: a page's viewed products with their places, the first variant of each product id; null or empty without any.

    The doubles are found by sorting a page's own list, so no rows meet others.
    """
    raw = F.regexp_extract(html, r'"events":"([^"\\]*+(?:\\.[^"\\]*+)*+)"', 1)  # possessive: no recursion, pages of any size
    text = F.from_json(F.concat(F.lit('{"t":"'), raw, F.lit('"}')), "t string").t
    events = F.from_json(text, "array<array<string>>")
    viewed = F.flatten(F.transform(F.filter(events, lambda e: e[0] == "collection_viewed"), lambda e: F.from_json(F.get_json_object(e[1], "$.collection.productVariants"), VARIANTS)))
    placed = F.transform(viewed, lambda v, k: F.struct(v.product.id.alias("id"), k.alias("slot"), F.lower(F.regexp_extract(F.substring_index(v.product.url, "?", 1), r"products/([^/?#]+)", 1)).alias("handle"), v.alias("v")))
    sorted_ = F.array_sort(F.filter(placed, lambda x: x.id.isNotNull()), lambda a, b: F.when(a.id < b.id, -1).when(a.id > b.id, 1).otherwise(a.slot - b.slot))
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(sorted_, lambda x: x.id))
    first = F.filter(F.zip_with(sorted_, before, lambda x, p: F.struct(x.alias("x"), (x.id == p).alias("again"))), lambda z: z.x.isNotNull() & ~F.coalesce(z.again, F.lit(False)) & (z.x.handle != ""))
    return F.array_sort(F.transform(first, lambda z: F.struct(z.x.slot.alias("slot"), z.x.handle.alias("handle"), z.x.v.alias("v"))), lambda a, b: a.slot - b.slot)


def event_items(pages: DataFrame) -> DataFrame:
    """A2: products of the ``collection_viewed`` events in a page's escaped JSON.

    Columns as ``ITEMS``; slots are in document order and the first variant of each
    product stands for it. Pages without such an event give no rows; each page row
    stands by itself, repeated ids included.
    """
    return _of_items(pages, viewed_items(F.col("html")))


def _of_items(pages: DataFrame, items: Column) -> DataFrame:
    base = F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1)
    own = pages.select("page_id", base.alias("base"), F.regexp_extract("url", SHOP, 1).alias("store_id"), F.inline(items))
    title = F.coalesce(F.nullif(F.trim("v.product.untranslatedTitle"), F.lit("")), F.nullif(F.trim("v.product.title"), F.lit("")), F.initcap(F.replace("handle", F.lit("-"), F.lit(" "))))
    image = F.coalesce(F.col("v.image.src"), F.lit(""))
    image = F.when(image.startswith("//"), F.concat(F.lit("https:"), image)).when(image.startswith("/"), F.concat("base", image)).otherwise(image)
    price = F.coalesce(F.format_string("%.2f", "v.price.amount"), F.lit(""))
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return own.select("page_id", "store_id", (F.col("slot") + 1).alias("slot"), "handle", title.alias("title"), F.when(F.col("v.price.amount").isNull(), "").otherwise(price).alias("price"), blank("v.product.vendor").alias("vendor"),
                      blank("v.product.type").alias("product_type"), image.alias("image_url"), F.concat("base", F.lit("/products/"), "handle").alias("product_url"))


class _Tree(HTMLParser):
    """Elements in document order: tag, attributes, parent, and where each one's elements and texts end."""

    VOID = {"img", "br", "input", "meta", "link", "hr", "source"}

    def __init__(self, html: str):
        super().__init__()
        self.tag, self.attrs, self.parent, self.end, self.first_text, self.last_text = [""], [{}], [-1], [0], [0], [0]
        self.texts: list[str] = []
        self.open = [0]
        self.feed(html)
        self.close_to(0)

    def close_to(self, depth: int) -> None:
        for k in self.open[depth:]:
            self.end[k], self.last_text[k] = len(self.tag), len(self.texts)
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        k = len(self.tag)
        for own, value in ((self.tag, tag), (self.attrs, {n: v or "" for n, v in attrs}), (self.parent, self.open[-1]), (self.end, k + 1), (self.first_text, len(self.texts)), (self.last_text, len(self.texts))):
            own.append(value)
        if tag not in self.VOID:
            self.open.append(k)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[depth]] == tag:
                self.close_to(depth)
                break

    def handle_data(self, data):
        if data.strip() and self.tag[self.open[-1]] not in ("script", "style"):
            self.texts.append(data.strip())

    def text(self, k: int) -> str:
        return " ".join(self.texts[self.first_text[k] : self.last_text[k]])


def _clean(text: str) -> str:
    """A5 for a single text."""
    flat = re.sub(r"\s+", " ", text.strip())
    return "" if VARIANT.match(text) or flat.startswith(("{", "[{")) or '"id":' in flat or re.match(BADGE, flat) or not 2 <= len(flat) <= 300 else flat


def _image(attrs: dict[str, str]) -> str:
    for name in ("src", "data-src", "data-original", "data-srcset", "srcset"):
        value = attrs.get(name, "").split(",")[0].strip().split(" ")[0] if "srcset" in name else attrs.get(name, "").strip()
        if value.startswith(("//", "http", "/")):
            return "https:" + value if value.startswith("//") else value
    return ""


def _price(text: str) -> str:
    found = None if "%" in text else PRICE.search(text) or WHOLE_PRICE.search(text)
    return found.group() if found else ""


def _cards(html: str, link: str = LINK) -> list[tuple[str, str, str, str]]:
    """``handle, title, price, image`` per product link of the main region, in document order."""
    tree = _Tree(html)
    of_class = [a.get("class", "") for a in tree.attrs]
    main = next((k for test in (lambda k: tree.tag[k] == "main", lambda k: tree.attrs[k].get("id") == "MainContent", lambda k: tree.tag[k] == "body") for k in range(len(tree.tag)) if test(k)), 0)
    nodes = lambda test: [k for k in range(len(tree.tag)) if test(k)]
    handle_of = {k: m.group(1).lower() for k in nodes(lambda k: tree.tag[k] == "a") if (m := re.search(link, tree.attrs[k].get("href", "").split("?")[0].split("#")[0]))}
    links, titles, prices = list(handle_of), nodes(lambda k: TITLE_CLASS.search(of_class[k])), nodes(lambda k: PRICE_CLASS.search(of_class[k]))
    images, sources = nodes(lambda k: tree.tag[k] == "img"), nodes(lambda k: tree.tag[k] == "source")
    before = lambda held: list(accumulate((k in held for k in range(len(tree.tag))), initial=0))
    images_before, marked_before = before(set(images)), before({*titles, *prices})

    def within(own: list[int], k: int) -> Iterator[int]:
        at = bisect_left(own, k)
        while at < len(own) and own[at] < tree.end[k]:
            yield own[at]
            at += 1

    def card_of(k: int) -> int:
        for _ in range(STEPS_UP):
            if tree.parent[k] < 0:
                return k
            k = tree.parent[k]
            held = images_before[tree.end[k]] > images_before[k] and marked_before[tree.end[k]] > marked_before[k + 1]
            if tree.tag[k] in ("li", "article") or tree.tag[k] in ("div", "section") and (CARD_CLASS.search(of_class[k]) or held):
                return k
        return k

    out, seen = [], set()
    for k in within(links, main):
        handle = handle_of[k]
        if handle in seen:
            continue
        seen.add(handle)
        card = card_of(k)
        texts = (t for own in ([k], within(links, card), within(titles, card)) for j in own if (t := _clean(tree.text(j))))
        title = next(texts, "") or _clean(next((tree.attrs[j].get("alt", "") for j in within(images, card)), "")) or handle.replace("-", " ").title()
        price = next((p for j in within(prices, card) if not BADGE_CLASS.search(of_class[j]) and (p := _price(tree.text(j)))), "")
        image = next((i for own in (images, sources) for j in within(own, card) if (i := _image(tree.attrs[j]))), "")
        out.append((handle, title, price, image))
    return out


def card_items(pages: DataFrame, link: str = LINK) -> DataFrame:
    """A3, A4: product links with title, price and image of their cards; columns as ``ITEMS``.

    Each page row stands by itself, repeated ids included. A null page has no links.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, u, i + 1, *c) for p, u, html in zip(frame.page_id, frame.url, frame.html, strict=True) for i, c in enumerate(_cards(html or "", link))]
            yield pd.DataFrame(rows, columns=["page_id", "url", "slot", "handle", "title", "price", "image_url"])

    found = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), "html").mapInPandas(run, "page_id long, url string, slot int, handle string, title string, price string, image_url string")
    base = F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1)
    return found.select("page_id", F.regexp_extract("url", SHOP, 1).alias("store_id"), "slot", "handle", "title", "price", F.lit("").alias("vendor"), F.lit("").alias("product_type"), "image_url", F.concat(base, F.lit("/products/"), "handle").alias("product_url"))


def page_items(pages: DataFrame) -> DataFrame:
    """A2, A3: the JSON items of a page, or its cards if there are none.

    What the events of a page hold is found once and stored, with the html of pages
    without such items, so both kinds are read from there.
    """
    json = F.coalesce(F.contains("html", F.lit('"events":"')), F.lit(False))
    parsed = pages.select("page_id", "url", "html", F.when(json, viewed_items(F.col("html"))).alias("items"))
    some = F.coalesce(F.size("items"), F.lit(0)) > 0
    found = saved(parsed.select("page_id", "url", F.when(some, F.col("items")).alias("items"), F.when(~some, F.col("html")).alias("html"), some.alias("viewed")))
    return _of_items(found.where("viewed"), F.col("items")).unionByName(card_items(found.where("NOT viewed")))
