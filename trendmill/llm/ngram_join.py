"""N-gram Jaccard join with signature trees.

1. Each text becomes its set of word shingles (64-bit hashes). Equal sets are one
   node of the join, whatever their number.
2. A fixed-size count sketch over all shingles of all texts orders shingles from
   rare to common. Two sets with Jaccard >= t share at least m of their first
   n - ceil(t * n) + m shingles in *any* common order, so the order decides the
   cost and never the result.
3. Sets with fewer than m such shingles that another set has too are linked with
   nothing. Of the others, pairs are counted where at most ``HELD`` sets hold a
   shingle, and those that share m of them are edges; sets with m shingles of more
   holders are also joined with whatever holds one of these. Candidate clusters are
   the connected components. A linked pair is always inside one cluster, and sets
   that share a few shingles by chance don't meet, however many there are. Rows of
   shingles that the sketch knows as frequent are met by minima combined before the
   shuffle, so neither copies nor common passages bring their rows to one task.
4. In each cluster a signature tree is built: nodes hold the OR of their sets'
   token bitmaps and the range of set sizes. A dual traversal drops node pairs
   whose largest possible overlap is too small; surviving pairs of sets are
   compared exactly. A cluster of more than ``unit`` sets, or of very many shingles,
   is dealt into blocks by size class and hash, and each compatible pair of blocks
   is traversed by itself.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .storage import join_uneven, split_by_keys, stored
from .text import U, chunks, mix, shingle_sets

SKETCH_BITS = 24
SKETCH_PART = 1 << 16
LEAF = 8
SHARED = 6
HELD = 16
HOT_ROWS, HOT_SLOTS = 500, 100_000
UNIT_SHINGLES = 1 << 21


def required_shared(n: int, percent: int) -> int:
    """How many leading shingles a set of ``n`` must share with any set it is linked with."""
    return min(SHARED, (n * percent + 99) // 100)


def required_prefix(n: int, percent: int) -> int:
    """How many leading shingles must hold those shared ones."""
    return n - (n * percent + 99) // 100 + required_shared(n, percent)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(64 - SKETCH_BITS)).astype(np.int64)


def _count_shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                for own in shingle_sets(chunk, width):
                    np.add.at(total, _slot(own), 1)
        for k in range(len(total) // SKETCH_PART):
            part = total[k * SKETCH_PART : (k + 1) * SKETCH_PART]
            if part.any():
                yield _part(k, zlib.compress(part.tobytes(), 1))

    return run


def _part(k: int, counts: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "counts": pa.array([counts], pa.binary())})


def _add_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(zlib.decompress(counts), dtype=np.int32).astype(np.int64)
            total[part] = total[part] + own if part in total else own
    for part, counts in total.items():
        yield _part(part, np.minimum(8 * np.log2(1 + counts), 255).astype(np.uint8).tobytes())


def shingle_levels(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """Commonness of shingles over all texts: 2**24 one-byte levels, at any input size."""
    schema = "part int, counts binary"
    counted = docs.select(text).mapInArrow(_count_shingles(width), schema)
    levels = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    for row in counted.repartition(16, "part").mapInArrow(_add_parts, schema).collect():
        levels[row["part"] * SKETCH_PART : (row["part"] + 1) * SKETCH_PART] = np.frombuffer(row["counts"], dtype=np.uint8)
    return levels


def hot_level(levels: np.ndarray) -> int:
    """The level from which a counter is frequent: at most ``HOT_SLOTS`` of them can be, whatever the input."""
    counters = np.zeros(256, dtype=np.int64)
    for first in range(0, len(levels), SKETCH_PART):  # the driver holds no second array of all counters
        counters += np.bincount(levels[first : first + SKETCH_PART], minlength=256)
    total = float(np.exp2(np.arange(256) / 8.0) @ counters - len(levels))
    return min(255, math.ceil(8 * math.log2(1 + max(HOT_ROWS, total / HOT_SLOTS))))


def _set_key(shingles: np.ndarray) -> int:
    if not len(shingles):
        return 0
    total = np.array([shingles.sum(), np.bitwise_xor.reduce(shingles) + U(len(shingles))], dtype=np.uint64)
    return int(mix(mix(total[:1]) + total[1:]).view(np.int64)[0])


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _describe(width: int, percent: int, levels, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                sizes, keys, rare, frequent = [], [], [], []
                for own in shingle_sets(chunk, width):
                    sizes.append(len(own))
                    keys.append(_set_key(own))
                    common = level[_slot(own)]
                    prefix = np.argsort(common, kind="stable")[: required_prefix(len(own), percent) if len(own) else 0]
                    rare.append(own[prefix[common[prefix] < hot]])
                    frequent.append(own[prefix[common[prefix] >= hot]])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(chunk.first, chunk.rows) for k in (0, 1, 3)), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), _lists(rare), _lists(frequent)],
                    names=["row_id", "doc_id", "text_key", "n_shingles", "set_key", "rare", "frequent"],
                )

    return run


def _described(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Sizes, keys and leading shingles of all texts' sets; the driver lets go of the levels when they are written."""
    levels = shingle_levels(docs, "text", width)
    hot, levels = hot_level(levels), docs.sparkSession.sparkContext.broadcast(levels)
    try:
        return stored(docs.mapInArrow(_describe(width, percent, levels, hot), "row_id long, doc_id long, text_key long, n_shingles long, set_key long, rare array<long>, frequent array<long>"))
    finally:
        levels.destroy()


class SignatureTree:
    """Levels from leaves (sets) to the root: bitmaps, size ranges, bitmap slack.

    The slack of a set is its size minus its bits: a set shares at most
    popcount(own & other) + slack shingles with whatever the other bitmap covers.
    """

    def __init__(self, sets: list[np.ndarray], bits: int):
        sizes = np.array([len(s) for s in sets])
        maps = np.zeros((len(sets), bits // 64), dtype=np.uint64)
        for k, own in enumerate(sets):
            slot = own & U(bits - 1)
            np.bitwise_or.at(maps[k], (slot >> U(6)).astype(np.int64), U(1) << (slot & U(63)))
        slack = sizes - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, sizes, sizes, slack)]
        while len(maps) > 1:
            cut = np.arange(0, len(maps), LEAF)
            maps = np.bitwise_or.reduceat(maps, cut, axis=0)
            low, high, slack = np.minimum.reduceat(self.levels[-1][1], cut), np.maximum.reduceat(self.levels[-1][2], cut), np.maximum.reduceat(slack, cut)
            self.levels.append((maps, low, high, slack))


def possible(left, right, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Can any set below left[i] and any below right[j] reach the similarity?"""
    (lm, ll, lh, ls), (rm, rl, rh, rs) = left, right
    a, b = ll[i], rl[j]
    keep = (lh[i] * 100 >= percent * b) & (rh[j] * 100 >= percent * a)
    at = np.flatnonzero(keep)
    for part in np.array_split(at, max(1, len(at) * lm.shape[1] // (1 << 20))):
        p, q = i[part], j[part]
        shared = np.bitwise_count(lm[p] & rm[q]).sum(axis=1).astype(np.int64) + np.minimum(ls[p], rs[q])
        shared = np.minimum(shared, np.minimum(lh[p], rh[q]))
        keep[part] = shared * (100 + percent) >= percent * (a[part] + b[part])
    return keep


def _children(nodes: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    child = nodes[:, None] * LEAF + np.arange(LEAF)
    return np.minimum(child, below - 1), child < below


def candidate_pairs(left: SignatureTree, right: SignatureTree, same: bool, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dual traversal from both roots; yields surviving pairs of sets in batches."""
    step = 1 << 14
    heights = len(left.levels) - 1, len(right.levels) - 1
    stack = [(heights[0], heights[1], np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while stack:
        lv, rv, i, j = stack.pop()
        if len(i) > step:
            stack += [(lv, rv, i[k : k + step], j[k : k + step]) for k in range(0, len(i), step)]
            continue
        keep = possible(left.levels[lv], right.levels[rv], i, j, percent)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if lv == 0 and rv == 0:
            yield i, j
            continue
        down_left, down_right = lv >= rv and lv > 0, rv >= lv and rv > 0
        if down_left:
            child, real = _children(i, len(left.levels[lv - 1][1]))
            i, j = child[real], np.repeat(j[:, None], LEAF, axis=1)[real]
            lv -= 1
        if down_right:
            child, real = _children(j, len(right.levels[rv - 1][1]))
            i, j = np.repeat(i[:, None], LEAF, axis=1)[real], child[real]
            rv -= 1
        if same and lv == rv:
            own = i < j if lv == 0 else i <= j
            i, j = i[own], j[own]
        stack.append((lv, rv, i, j))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    shared = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def spanning_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """A forest of true links with the same components as all links (indexes; right ones follow left ones)."""
    both = left + (right or [])
    most = max(len(s) for s in both)
    bits = min(1 << 16, max(512, 1 << (8 * most - 1).bit_length()))
    tree = SignatureTree(left, bits)
    other = SignatureTree(right, bits) if right else tree
    shift = len(left) if right else 0
    label = np.arange(len(both))
    found: list[tuple[int, int]] = []
    for i, j in candidate_pairs(tree, other, not right, percent):
        j = j + shift
        while True:
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
            if not len(i):
                break
            for x, y in zip(i[:64].tolist(), j[:64].tolist(), strict=True):
                if label[x] != label[y] and linked(both[x], both[y], percent):
                    label[label == label[y]] = label[x]
                    found.append((x, y))
            i, j = i[64:], j[64:]
    return found


def stars(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """Each end of ``pairs`` that isn't the least of its component, and that least one."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    for x, y in pairs:
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {x: top(x) for x in up}


def _join_unit(width: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        known = table.column("set_key").to_numpy()
        side = table.column("side").to_numpy()
        texts = table.column("text").combine_chunks()
        sets: tuple[dict[int, np.ndarray], ...] = ({}, {})
        for chunk in chunks(texts):
            for k, own in enumerate(shingle_sets(chunk, width), chunk.first):
                key = _set_key(own)
                if key == known[k]:  # a repeated id may bring another text
                    sets[side[k]][key] = own
        left, right = (dict(sorted(f.items(), key=lambda s: (s[1][0], len(s[1]), s[0]))) for f in sets)
        keys = [*left, *right]
        pairs = spanning_links([*left.values()], [*right.values()] or None, percent) if left else []
        found = stars([(keys[x], keys[y]) for x, y in pairs])  # most clusters are one unit, so no round of contraction is left
        return pa.table({"a": pa.array([*found.keys()], pa.int64()), "b": pa.array([*found.values()], pa.int64())})

    return run


def _held_twice(rows: DataFrame) -> DataFrame:
    """Different rows whose shingle another set has too, the least such set as ``low`` and the number of the shingle's rows, copies included, as ``held``.

    Rows of frequent shingles (``hot``) are joined with what their shingles' minima
    and maxima leave, a small table; the planner decides how. The others have no
    more rows a shingle than a counter that isn't frequent.
    """
    both = rows.where("NOT hot").selectExpr("*", "min(set_key) OVER (PARTITION BY shingle) AS low", "max(set_key) OVER (PARTITION BY shingle) AS high", "count(*) OVER (PARTITION BY shingle) AS held")
    # equal rows have met by their shingle, so making these distinct moves nothing
    both = both.where("low != high").drop("high").distinct()
    ends = stored(rows.where("hot").groupBy("shingle").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high"), F.count("*").alias("held")).where("low != high").drop("high"))
    return both.unionByName(rows.where("hot").join(ends, "shingle").distinct())


def _strong(shared: DataFrame) -> DataFrame:
    """Sets with enough shared shingles to be linked, and how many of these have more than ``HELD`` holders."""
    found = shared.groupBy("set_key").agg(F.count("*").alias("n"), F.first("least").alias("least"), F.count_if(F.col("held") > HELD).alias("wide"))
    return found.where("n >= least").select("set_key", "wide")


def candidate_edges(shared: DataFrame) -> DataFrame:
    """``a, b`` of sets whose components hold every linked pair, from different ``shared(set_key, least, shingle, hot, low, held)``.

    A linked pair shares ``least`` of either set's rows. Shingles of at most ``HELD``
    sets are met pair by pair, those of the same sets at once; a pair must share what
    the shingles of more sets, ``wide`` of either, can't bring. Only if these may be
    enough alone, a set is joined with the least such set of each.
    """
    rows = shared.join(_strong(shared), "set_key").drop("low")
    common = _held_twice(stored(rows.where(F.col("held") > HELD).where("wide >= least").drop("held")))
    together = rows.where(F.col("held") <= HELD).groupBy("shingle").agg(F.array_sort(F.collect_list(F.struct("set_key", F.expr("greatest(1, least - wide) AS need")))).alias("sets"))
    lists = together.groupBy("sets").agg(F.count("*").alias("n"))
    pairs = lists.select("n", F.explode(F.expr("flatten(transform(sets, (s, i) -> transform(slice(sets, i + 2, size(sets)), t -> struct(s.set_key AS a, t.set_key AS b, greatest(s.need, t.need) AS need))))")).alias("pair"))
    near = pairs.groupBy("pair.a", "pair.b").agg(F.sum("n").alias("n"), F.first("pair.need").alias("need")).where("n >= need")
    return near.select("a", "b").unionByName(common.select(F.col("set_key").alias("a"), F.col("low").alias("b")))


def _units(candidates: DataFrame, unit: int, percent: int) -> DataFrame:
    """Deal each cluster's sets to units: whole clusters, or pairs of blocks of a large one."""
    ratio = math.log(100 / percent) * (1 + 1e-9)
    sized = candidates.withColumn("size_class", F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(ratio)).cast("int"))
    # what counts of a set is its share of a unit's sets or of its shingles
    load = F.greatest(F.lit(1.0 / unit), F.col("n_shingles") / F.lit(float(UNIT_SHINGLES)))
    classes = sized.groupBy("cluster", "size_class").agg(F.sum(load).alias("of_class"))
    # a cluster's sizes are of a hundred classes at most: one small map a cluster, met in one join
    blocks_of = F.map_from_entries(F.collect_list(F.struct("size_class", F.ceil(F.col("of_class") * 2).cast("int"))))
    wholes = classes.groupBy("cluster").agg(F.sum("of_class").alias("of_cluster"), blocks_of.alias("blocks_of"))
    own, up, down = F.col("size_class"), F.col("size_class") + 1, F.col("size_class") - 1
    dealt = sized.join(wholes, "cluster").withColumns({"blocks": F.try_element_at("blocks_of", own), "above": F.try_element_at("blocks_of", up), "below": F.try_element_at("blocks_of", down)})
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int"))

    def uses(lo_class, lo_block, hi_class, hi_block, side):
        return F.struct(F.xxhash64("cluster", lo_class, lo_block, hi_class, hi_block).alias("unit"), side.cast("int").alias("side"))

    block = F.col("block")
    within = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: uses(own, F.least(block, k), own, F.greatest(block, k), block > k))
    upward = F.transform(F.sequence(F.lit(1), F.coalesce("above", F.lit(0))), lambda k: uses(own, block, up, k - 1, F.lit(False)))
    downward = F.transform(F.sequence(F.lit(1), F.coalesce("below", F.lit(0))), lambda k: uses(down, k - 1, own, block, F.lit(True)))
    none = F.array().cast("array<struct<unit:bigint,side:int>>")
    parts = F.concat(within, F.when(F.col("above") > 0, upward).otherwise(none), F.when(F.col("below") > 0, downward).otherwise(none))
    whole = F.array(F.struct(F.xxhash64("cluster").alias("unit"), F.lit(0).alias("side")))
    return dealt.select("row", "set_key", F.explode(F.when(F.col("of_cluster") <= 1, whole).otherwise(parts)).alias("use")).select("row", "set_key", "use.unit", "use.side")


def ngram_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, unit: int = 4096) -> DataFrame:
    """Exact components of the relation ``100 * |A & B| >= percent * |A | B|``.

    Returns ``doc_id, n_shingles, component_id, set_key, class, text_key, is_first``, one
    row per input row. ``class`` is equal for linked rows and null without shingles;
    ``text_key`` is Spark's xxhash64 of the text, to tell rows of one id apart;
    ``is_first`` marks a class's smallest id (null last), of these the smallest text key.
    A null or empty text has no shingles and is linked with nothing: its component
    is its own id. A null ``doc_id`` takes part; it never names a component that
    has another id. Repeated rows are rows of their own. An empty table gives no
    rows, other columns of ``docs`` are ignored, and no cap drops any pair.
    """
    own, words = F.col(doc_id).cast("long"), F.col(text)
    docs = docs.select(F.coalesce(own, F.xxhash64(words)).alias("row_id"), own.alias("doc_id"), words.alias("text"), F.xxhash64(words).alias("text_key"))
    described = _described(docs, width, percent)

    least = F.least(F.lit(SHARED), F.ceil(F.col("n_shingles") * percent / 100)).cast("int")
    rows = lambda column: described.select("set_key", least.alias("least"), F.explode(column).alias("shingle"), F.lit(column == "frequent").alias("hot"))
    shared = stored(_held_twice(rows("rare").unionByName(rows("frequent"))))
    shared = stored(_held_twice(shared.drop("low", "held").join(_strong(shared).select("set_key"), "set_key")))
    clusters = stored(connected_components(candidate_edges(shared)).withColumnRenamed("component", "cluster"))

    members = described.join(clusters, described.set_key == clusters.node).groupBy("set_key").agg(F.min(F.struct("row_id", "text_key")).alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("cluster").alias("cluster"))
    # a set's text is that of one row; its id alone may be that of many other texts
    units = _units(stored(members), unit, percent).select("row.row_id", "row.text_key", "set_key", "unit", "side")
    units = stored(units)
    few, _ = split_by_keys(docs, units, "text_key")
    placed = few.join(units.hint("shuffle_hash"), ["row_id", "text_key"]).select("unit", "side", "set_key", "text")
    links = placed.groupBy("unit").applyInArrow(_join_unit(width, percent), "a long, b long")
    components = connected_components(links)

    # one row per different set, whatever its number of copies
    sets = described.groupBy("set_key").agg(F.count("*").alias("copies"), F.first("n_shingles").alias("size")).join(components, F.col("set_key") == F.col("node"), "left")
    sets = sets.select("set_key", "copies", F.when(F.col("size") > 0, F.coalesce("component", "set_key")).alias("class"))
    named = stored(join_uneven(described.select("doc_id", "text_key", "n_shingles", "set_key"), sets, "set_key", "copies").select("doc_id", "text_key", "n_shingles", "set_key", "class"))
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")
    classes = named.where("class IS NOT NULL").groupBy("class").agg(F.min(place).alias("first"), F.count("*").alias("rows"))
    linked = join_uneven(named.where("class IS NOT NULL"), classes, "class", "rows")
    alone = named.where("class IS NULL").withColumns({"first": place, "rows": F.lit(1).cast("long")})
    both = linked.unionByName(alone).withColumn("is_first", place == F.col("first"))
    return both.select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), "set_key", "class", "text_key", "is_first")
