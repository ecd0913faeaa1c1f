"""Fill-in-middle forms of texts, cut between tokens by one counted match.

``regexp_count`` tells a text's number n of tokens. The row's own pattern then has
two possessive groups of counted tokens and a rest, so one match yields prefix,
middle and suffix, and its replacement is the output. Possessive groups loop
instead of recursing, so texts of any length pass. All of it is SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE, OTHER = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
UNIT = f"(?:{SPACE}*+{OTHER}++|{SPACE}++)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKED = f"{PREFIX}|{SUFFIX}|{MIDDLE}"


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the sha256 of ``seed:doc_id``; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, *, seed: int = 42, rate: int = 50, spm: int = 80, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``, then the columns ``keep``.

    ``rate`` percent of the texts are rearranged, ``spm`` percent of these with the
    suffix first. Empty texts and those that contain a marker stay ``plain``, with
    null lengths. A null text counts as empty. A row depends on its id and text
    alone: repeated ids with one text give equal rows, those with several are cut at
    places of one drawing; other columns don't matter, an empty table gives no rows.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), *(F.col(c).alias(f"_kept_{c}") for c in keep))
    h = draws(F.col("doc_id"), seed)
    counted = own.withColumn("n", F.regexp_count("_text", F.lit(UNIT)).cast("long"))
    places = [h[k] % (F.col("n") + 1) for k in (0, 1)]
    plain = (F.col("_text") == "") | F.col("_text").rlike(MARKED) | (h[2] % 100 >= rate)
    cut = counted.select("*", F.least(*places).alias("_a"), F.greatest(*places).alias("_b"), F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm").alias("form"))
    pattern = F.format_string(rf"(?s)\A({UNIT}{{%d}}+)({UNIT}{{%d}}+)(.*+)", F.col("_a"), F.col("_b") - F.col("_a"))
    made = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    done = cut.withColumn("output", F.when(F.col("form") == "plain", F.col("_text")).otherwise(F.regexp_replace("_text", pattern, made)))
    parts = pieces(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", F.char_length(parts[0]).cast("long").alias("prefix_chars"), F.char_length(parts[1]).cast("long").alias("middle_chars"), "output", *(F.col(f"_kept_{c}").alias(c) for c in keep))


def between(output: Column, left: str, right: str | None) -> Column:
    """What stands after the one ``left`` and before the one ``right``, or the end."""
    rest = F.substring_index(output, left, -1)
    return rest if right is None else F.substring_index(rest, right, 1)


def pieces(output: Column, form: Column) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix of an output; null if it is plain.

    Texts with a marker are never rearranged, and no marker's end is another's start,
    so each marker stands once in an output.
    """
    spm = form == "spm"
    prefix = F.when(spm, between(output, PREFIX, MIDDLE)).when(form == "psm", between(output, PREFIX, SUFFIX))
    suffix = F.when(spm, between(output, SUFFIX, PREFIX)).when(form == "psm", between(output, SUFFIX, MIDDLE))
    return prefix, F.when(form != "plain", between(output, MIDDLE, None)), suffix


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    prefix, middle, suffix = pieces(output, form)
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))
