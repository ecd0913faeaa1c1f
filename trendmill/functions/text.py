"""Scalar text functions as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts of buttons and badges that aren't titles.
BADGE = (
    r"(?iu)^\s*(reduziert|reduced|sale|im\s*sale|on\s*sale|discount|clearance|neu(?:heit)?|new|nouveau|nouveauté|featured|bestseller|best[\s\-]*seller|"
    r"top|hot|trending|out\s*of\s*stock|sold\s*out|-?\d+\s*%|save\s*-?\d+\s*%?|spare\s*-?\d+\s*%?)\s*$"
)
#: Words that name a gender, by language.
MEN = "men|man|men's|mens|homme|hommes|herren|herr|hombre|hombres|uomo|uomini|heren"
WOMEN = "women|woman|women's|womens|ladies|lady|femme|femmes|dame|damen|dama|mujer|mujeres|donna|donne|dames"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def clean_title(c: Column) -> Column:
    """A5: blank for JSON, badges and over 300 characters; white space collapsed."""
    t = F.trim(text_or_empty(c))
    flat = F.regexp_replace(t, r"\s+", " ")
    return F.when(t.rlike(r'(?s)^[\[{].*"id"\s*:\s*[0-9]') | t.startswith("[{") | t.startswith("{") | t.contains('"id":') | t.rlike(BADGE) | (F.length(flat) > 300), "").otherwise(flat)


def image_url(c: Column) -> Column:
    """Absolute or rooted image addresses, else blank."""
    t = F.trim(text_or_empty(c))
    return F.when(t.startswith("//"), F.concat(F.lit("https:"), t)).when(t.startswith("http") | t.startswith("/"), t).otherwise("")


def store_url(c: Column) -> Column:
    """Scheme and host of a store address; https if there is no scheme."""
    t = F.trim(text_or_empty(c))
    full = F.when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))
    return F.when(t == "", "").otherwise(F.lower(F.regexp_extract(full, r"^([A-Za-z]+://[^/?#]*)", 1)))


def reject_reason(name: Column, url: Column) -> Column:
    """Why a store can't be saved, or null."""
    n, clean = F.trim(text_or_empty(name)), store_url(url)
    host = F.substring_index(clean, "://", -1)
    # fixed values: messages
    return (
        F.when(n == "", "Store name is required").when(F.length(n) > 255, "Store name must be 255 characters or fewer")
        .when(F.trim(text_or_empty(url)) == "", "Store URL is required").when(~clean.rlike("^https?://"), "Store URL must start with http:// or https://")
        .when(~host.contains("."), "Store URL host looks invalid (missing TLD?)")
    )


def visitors(c: Column) -> Column:
    """B7: "24K" and "1.9M" as numbers, truncated; anything else that is no whole number is 0."""
    t = F.upper(F.trim(text_or_empty(c)))
    number = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)[KM]?$", 1).try_cast("double")
    factor = F.when(t.endswith("K"), 1e3).when(t.endswith("M"), 1e6)
    whole = F.when(t.rlike("^[0-9]+$"), t).try_cast("bigint")
    return F.coalesce((number * factor).cast("bigint"), whole, F.lit(0))


def split_list(c: Column) -> Column:
    """Distinct lower-cased parts of a comma list, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(text_or_empty(c)), ","), lambda x: F.trim(x)), lambda x: x != ""))


def render_tags(kind: Column, gender: Column, confidence: Column, colors: Column, materials: Column, occasion: Column, attributes: Column, old: Column) -> Column:
    """Image tokens, then the old text tags after a double bar."""
    one = lambda prefix, c: F.when(F.trim(text_or_empty(c)) != "", F.array(F.concat(F.lit(prefix), F.lower(F.trim(c))))).otherwise(F.array().cast("array<string>"))
    many = lambda prefix, c: F.transform(split_list(c), lambda x: F.concat(F.lit(prefix), x))
    both = F.flatten(F.transform(split_list(attributes), lambda x: F.array(F.concat(F.lit("img:attr:"), x), F.concat(F.lit("img:"), x))))
    parts = F.concat(one("img:type:", kind), one("img:", kind), one("img:gender:", gender), one("img:conf:", confidence), many("img:color:", colors), many("img:material:", materials), many("img:occasion:", occasion), both)
    image, text = F.array_join(parts, ", "), F.trim(text_or_empty(old))
    return F.when((image != "") & (text != ""), F.concat(image, F.lit(" || "), text)).when(image != "", image).otherwise(text)


def clean_tags(c: Column) -> Column:
    """Plain tag words for embedding."""
    parts = F.split(F.regexp_replace(text_or_empty(c), r"\|\|", ","), ",")
    words = F.transform(parts, lambda x: F.trim(F.lower(F.replace(F.when(F.trim(x).startswith("img:"), F.substring_index(F.trim(x), ":", -1)).otherwise(x), F.lit("-"), F.lit(" ")))))
    return F.array_join(F.array_distinct(F.filter(words, lambda x: F.length(x) > 1)), ", ")


def embedding_text(title: Column, description: Column, tags: Column) -> Column:
    """What is embedded: the non-empty parts, 2000 characters at most."""
    full = lambda c: F.when(F.trim(text_or_empty(c)) != "", F.trim(c))
    return F.substring(F.concat_ws(". ", full(title), full(description), full(clean_tags(tags))), 1, 2000)


def image_file(c: Column) -> Column:
    """Last part of an image path, without query."""
    return F.substring(F.substring_index(F.regexp_replace(text_or_empty(c), r"\?.*$", ""), "/", -1), 1, 120)


def expects_both(niche: Column) -> Column:
    """Stores that should fill both feeds."""
    return F.lower(text_or_empty(niche)).rlike("&|multi|mixed")


def scrape_warning(niche: Column, fashion: Column, general: Column) -> Column:
    """What is wrong with a store's last run, or null."""
    # fixed values: messages
    return (
        F.when((fashion == 0) & (general == 0), "Dead scrape — both feeds empty").when(~expects_both(niche), None)
        .when(fashion == 0, "Fashion feed empty (mixed-niche store expected to populate both)").when(general == 0, "General feed empty (mixed-niche store expected to populate both)")
    )


def _quoted(term: str) -> str:
    return reduce(lambda t, s: t.replace(s, "\\" + s), "\\.^$|?*+()[]{}", term)


def whole_word(c: Column, term: str) -> Column:
    """``term`` between word borders, any case."""
    return text_or_empty(c).rlike(rf"(?iU)(?<!\w){_quoted(term)}(?!\w)")


def loose_word(c: Column, term: str, mode: str = "substring") -> Column:
    """``term`` anywhere, or with mode ``border`` as a word or the end of one."""
    if mode == "substring":
        return F.lower(text_or_empty(c)).contains(term.lower())
    return text_or_empty(c).rlike(rf"(?iU){_quoted(term)}(?!\w)")


def mentions(c: Column, words: str) -> Column:
    return text_or_empty(c).rlike(rf"(?iU)\b({words})\b")


def gender_contradiction(query: Column, haystack: Column) -> Column:
    """The row speaks only of the gender that the query didn't ask for."""
    men, women = mentions(haystack, MEN), mentions(haystack, WOMEN)
    return (mentions(query, WOMEN) & men & ~women) | (mentions(query, MEN) & women & ~men)


def singulars(c: Column) -> Column:
    """A term and its naive singulars."""
    cut = lambda n: F.left(c, F.length(c) - n)
    first = F.when((F.length(c) > 3) & c.endswith("s") & ~c.endswith("ss"), cut(F.lit(1)))
    second = F.when((F.length(c) > 4) & c.endswith("es"), cut(F.lit(2)))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(c, first, second))))


def plural_variants(c: Column) -> Column:
    """Singular or plural spellings of a token."""
    t = F.lower(F.trim(text_or_empty(c)))
    cut = lambda n: F.left(t, F.length(t) - F.lit(n))
    more = (
        F.when(F.length(t) <= 3, F.array(t)).when(t.endswith("ies"), F.array(t, F.concat(cut(3), F.lit("y"))))
        .when(t.endswith("es") & ~t.endswith("oes"), F.array(t, cut(2), cut(1))).when(t.endswith("s") & ~t.endswith("ss"), F.array(t, cut(1)))
        .otherwise(F.array(t, F.concat(t, F.lit("s")), F.concat(t, F.lit("es"))))
    )
    return F.array_sort(F.array_distinct(more))
