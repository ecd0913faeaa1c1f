"""Grouping of spelling variants by a frontier that walks a trie, as joins.

The words' trie is a distributed table of edges (node, letter, child); nodes are
hashes of prefixes. A state is (word, position, node, edits): the word's first
``position`` letters have led to ``node``. Without an edit a word's states are its
own prefixes. One edit leaves its path for another child; from then on each level
joins the living states with the edges of their depth by node and next letter, and a
state whose word ends at the end of a trie word has found a neighbour.

Of two neighbours one has all its edits in the second half of the word or of the
reversed word, so both tries are walked from the middle on, where few words share a
node. Every edge tells in 128 bits what may follow its child, and states with no
such rest are dropped at once. An edit is an exchanged or an added letter; a letter
is taken away where the other word adds it.

Words of 64 letters and more would need as many levels: they meet by the hashes of
what one deletion leaves, which are as many as the word has letters. Node and rest
hashes have 64 bits.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .text import U, mix

RUN = "[a-zÀ-ÿ]"
LONG = 64  # letters from which words don't walk the trie
HELD = 200_000  # distinct words that a task counts before it hands them on
BASE = 0x9E3779B97F4A7C15
PIECE = 1 << 16


def typo(run: str, start: int) -> str:
    """The run without one letter, if 31 divides its checksum; ``start`` is that of what precedes it."""
    h = zlib.crc32(run.encode(), start)
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, least_length: int) -> DataFrame:
    """``word, n``: how often each run of letters of at least ``least_length`` stands in all texts, after ``typo``."""
    runs = re.compile(f"{RUN}{{{least_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(list(held.keys()), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                if text:
                    start = zlib.crc32(f"{'' if doc_id.as_py() is None else doc_id.as_py()}:".encode())
                    # bytes are lower-cased in ASCII alone
                    for word, n in Counter(runs.findall(text.encode().lower().decode())).items():
                        held[typo(word, start)] += n
                    if len(held) > HELD:
                        yield counted()
                        held.clear()
        yield counted()

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return found.where(F.char_length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n"))


# ---- words that walk the trie ---------------------------------------------


def along(word: Column, side: Column) -> Column:
    """The word in the direction of a trie."""
    return F.when(side == 0, word).otherwise(F.reverse(word))


def bit(rest: Column) -> tuple[Column, Column]:
    """One of 128 bits, as two numbers."""
    slot = F.pmod(F.xxhash64(rest), F.lit(128)).cast("int")
    one = F.expr("1L")
    return F.when(slot < 64, F.call_function("shiftleft", one, slot)).otherwise(F.lit(0).cast("long")), F.when(slot >= 64, F.call_function("shiftleft", one, slot - 64)).otherwise(F.lit(0).cast("long"))


def may_follow(rest: Column) -> Column:
    """Can the child of an edge be followed by ``rest``?"""
    low, high = bit(rest)
    return F.when(low != 0, F.col("low").bitwiseAND(low) != 0).otherwise(F.col("high").bitwiseAND(high) != 0)


def own_paths(words: DataFrame) -> DataFrame:
    """States without edits, and one more before them for the edges of shorter words' neighbours (``own`` false)."""
    size = F.char_length("word")
    sides = words.select("word", size.alias("size"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).withColumn("letters", along(F.col("word"), F.col("side")))
    first, middle = F.expr("(size - 1 + side) div 2").cast("int"), F.expr("(size + side) div 2")
    placed = sides.select("*", F.explode(F.sequence(first, F.col("size"))).alias("position")).withColumn("own", F.col("position") >= middle)
    cut = F.substring("letters", F.lit(1), F.col("position"))
    return placed.select("word", "side", "position", "own", F.xxhash64("side", cut).alias("node"), F.substring("letters", F.col("position") + 1, F.lit(LONG)).alias("rest"), "letters")


def edge_table(paths: DataFrame) -> DataFrame:
    """``depth, node, letter, child, low, high, ending``: all edges; an empty letter ends the word ``ending``."""
    letter = F.substring("rest", 1, 1)
    child = F.xxhash64("side", F.substring("letters", F.lit(1), F.col("position") + 1))
    low, high = bit(F.substring("rest", 2, LONG))
    ends = F.when(letter == "", F.col("word"))
    grouped = paths.select("node", letter.alias("letter"), F.when(letter != "", child).alias("child"), F.col("position").alias("depth"), low.alias("low"), high.alias("high"), ends.alias("ending"))
    return grouped.groupBy("depth", "node", "letter", "child").agg(F.bit_or("low").alias("low"), F.bit_or("high").alias("high"), F.max("ending").alias("ending"))


def edited(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """The frontier after one edit: ``word, side, position, depth, node``; a letter exchanged or added."""
    others = edges.where("letter <> ''").select("node", "letter", "child", "depth", "low", "high")
    left = paths.where("own").select("word", "side", "position", "node", "rest")
    met = left.join(others, "node").where(F.substring("rest", 1, 1) != F.col("letter"))
    after = F.substring("rest", 2, LONG)
    exchanged, added = (F.col("rest") != "") & may_follow(after), may_follow(F.col("rest"))
    ways = met.withColumns({"_x": exchanged, "_a": added}).where("_x OR _a")
    steps = F.array(F.when(F.col("_x"), F.col("position") + 1), F.when(F.col("_a"), F.col("position")))
    return ways.select("word", "side", F.explode(F.array_compact(steps)).alias("position"), (F.col("depth") + 1).alias("depth"), F.col("child").alias("node"))


def one_level(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States of one depth joined with the edges there: found words as ``other``, else the next states."""
    rest = F.substring(along(F.col("word"), F.col("side")), F.col("position") + 1, F.lit(LONG))
    asked = states.withColumns({"letter": F.substring(rest, 1, 1), "_after": F.substring(rest, 2, LONG)})
    met = asked.join(edges.drop("depth"), ["node", "letter"])
    alive = (F.col("letter") == "") | may_follow(F.col("_after"))
    return met.where(alive).select("word", "side", (F.col("position") + 1).alias("position"), F.col("child").alias("node"), F.col("ending").alias("other"))


def near_short(words: DataFrame) -> DataFrame:
    """``word, other``: neighbours among words of at most ``LONG`` letters, one level of both tries after the other."""
    paths = own_paths(words.where(F.char_length("word") <= LONG).select("word"))
    edges = stored(edge_table(paths).sortWithinPartitions("depth"))
    fresh = stored(edited(paths, edges).sortWithinPartitions("depth"))
    born = {r["depth"] for r in fresh.select("depth").distinct().collect()}  # LONG numbers at most
    columns = ["word", "side", "position", "node"]
    states, found, depth = None, [], min(born, default=0)
    while states is not None or depth <= max(born, default=-1):
        now = fresh.where(F.col("depth") == depth).select(*columns) if depth in born else None
        now = states if now is None else now if states is None else states.unionByName(now)
        if now is not None:
            met = stored(one_level(now, edges.where(F.col("depth") == depth)))
            found.append(met.where("other IS NOT NULL").select("word", "other"))
            states = met.where("other IS NULL").select(*columns)
            states = None if states.isEmpty() else states
        depth += 1
    out = words.where("false").select("word", F.col("word").alias("other"))
    for part in found:
        out = out.unionByName(part)
    longer = F.char_length("other") > F.char_length("word")
    return out.unionByName(out.where(longer).select(F.col("other").alias("word"), F.col("word").alias("other"))).distinct()


# ---- very long words ------------------------------------------------------


def deletions(word: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the word with each one letter deleted, and the letters' places; last that of all, at place -1."""
    codes = mix(np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + U(1))
    size = len(codes)
    power = np.full(size + 1, BASE, dtype=np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    whole = np.concatenate([[U(0)], np.cumsum(codes * power[:-1])])
    inverse = U(pow(BASE, -1, 1 << 64))
    for a in range(0, size, PIECE):
        at = np.arange(a, min(size, a + PIECE))
        yield mix(whole[at] + (whole[-1] - whole[at + 1]) * inverse), at
    yield mix(whole[-1:]), np.array([-1])


def near_long(words: DataFrame) -> DataFrame:
    """``word, other``: neighbours among words of at least ``LONG`` letters, by equal hashes after a deletion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for hashes, at in deletions(word):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key)), pa.array(np.full(len(at), len(word))), pa.array(at), pa.array(hashes.view(np.int64))], names=["key", "size", "at", "hash"])

    own = words.where(F.char_length("word") >= LONG).select("word", F.xxhash64("word").alias("key"))
    cut = stored(own.mapInArrow(run, "key long, size long, at long, hash long"))
    other = lambda df: df.select(F.col("key").alias("other_key"), "size", "at", "hash")
    # the letters between the places of two equal ones of a run give one hash: one place is enough
    shorter = cut.where("at >= 0").groupBy("key", "hash").agg(F.min("at").alias("at")).join(other(cut.where("at < 0")).drop("at"), "hash").select("key", "other_key")
    equal = cut.where("at >= 0").join(other(cut.where("at >= 0")), ["size", "at", "hash"]).where("key <> other_key").select("key", "other_key")
    keys = shorter.unionByName(shorter.select(F.col("other_key").alias("key"), F.col("key").alias("other_key"))).unionByName(equal).distinct()
    named = own.select(F.col("key").alias("other_key"), F.col("word").alias("other"))
    return keys.join(own, "key").join(named, "other_key").select("word", "other")


# ---- variants -------------------------------------------------------------


def roots_of(forms: DataFrame) -> DataFrame:
    """``word, root``: forms followed to their ends by doubling steps; each form is the more frequent, so there is no loop."""
    roots = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        wider = stored(roots.join(ahead, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")))
        roots = wider.select("word", "root")
        if wider.where("_moved").isEmpty():
            return roots


def spelling_variants(docs: DataFrame, *, least_length: int = 7, least_count: int = 2, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all words of ``text``.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, with the letter
    deleted that ``typo`` names, of ``least_length`` letters and ``least_count``
    occurrences. ``form`` is the near word (one edit) of most occurrences, of equal
    ones the first in code-point order, if it has ``ratio`` times those of the word;
    ``root`` follows forms to the last. A null or empty text has no words, a null id
    counts as empty text in the checksum, every row counts, other columns don't
    matter, and an empty table gives no rows.
    """
    words = stored(count_words(docs, least_length).where(F.col("n") >= least_count))
    near = near_short(words).unionByName(near_long(words)).distinct()
    counts = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = near.join(counts, "other").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    joined = stored(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.less") >= ratio * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("to")))
    roots = roots_of(joined.where("to IS NOT NULL").select("word", "to.form"))
    return joined.join(roots, "word", "left").select("word", "to.form", F.coalesce("root", "word").alias("root"), "n", "n_near", "to.form_n")
