"""Approximate nearest neighbours over learned partitions.

Partitions form a tree that grows with the table. In each partition that is still
too large, a bounded sample gives a neighbour graph by inner products; balanced
partitioning of that graph (recursive halving by its slow vectors) labels the
sample, and a small classifier learns two things: where a vector is kept, and
where the neighbours of a query of that direction are. Every vector is indexed in
its most probable leaf. A query goes to its most probable partitions until they
hold ``coverage`` of its probability and enough vectors; all of these are compared
with it exactly. Equal vectors are searched once.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored

CELL_ROWS = 4096
QUERY_ROWS = 1024
NEIGHBOURS = 10
FANOUT = 64
SPLIT = 4  # a partition of more than so many leaves' rows is split
SALTS = 16


def knn_graph(rows: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Indexes of the k largest inner products of each row, itself excluded."""
    out = np.zeros((len(rows), min(k, len(rows) - 1)), dtype=np.int64)
    for a in range(0, len(rows), 1024):
        near = rows[a : a + 1024] @ rows.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        out[a : a + 1024] = np.argpartition(-near, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def _halves(graph: np.ndarray, own: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Balanced halving of the nodes ``own``: an approximate second eigenvector, cut at its median."""
    place = np.full(len(graph), -1)
    place[own] = np.arange(len(own))
    to = place[graph[own]]
    inside = to >= 0
    value = random.normal(size=len(own))
    source = np.repeat(np.arange(len(own)), to.shape[1])[inside.ravel()]
    target = to.ravel()[inside.ravel()]
    degree = np.bincount(source, minlength=len(own)) + np.bincount(target, minlength=len(own)) + 1
    for _ in range(60):
        value = value - np.average(value, weights=degree)
        value = (value + np.bincount(source, value[target], minlength=len(own)) + np.bincount(target, value[source], minlength=len(own))) / degree
        value /= np.linalg.norm(value) + 1e-12
    return np.argsort(np.argsort(value, kind="stable"), kind="stable") >= len(own) // 2


def partition_graph(graph: np.ndarray, depth: int) -> np.ndarray:
    """2**depth parts of equal size (within one), with few edges between them."""
    random = np.random.default_rng(23)
    label = np.zeros(len(graph), dtype=np.int64)
    for _ in range(depth):
        fresh = label * 2
        for part in np.unique(label):
            own = np.flatnonzero(label == part)
            fresh[own] += _halves(graph, own, random)
        label = fresh
    return label


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def inputs(rows: np.ndarray, typical: float, asks: bool) -> np.ndarray:
    """What the classifier reads: the direction, and for a kept vector also its length; a query's length means nothing."""
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    length = np.zeros_like(size) if asks else np.clip(np.log(size / typical), -4, 4)
    return np.concatenate([rows / size, length, np.full_like(size, float(asks))], axis=1)


def train_router(rows: np.ndarray, graph: np.ndarray, label: np.ndarray, parts: int, *, hidden: int = 96, passes: int = 60) -> dict[str, np.ndarray]:
    """One hidden layer. A kept vector's target is its part, a query's the parts of its neighbours."""
    random = np.random.default_rng(29)
    typical = float(np.median(np.linalg.norm(rows, axis=1)))
    near = np.zeros((len(rows), parts))
    for k in range(graph.shape[1]):
        np.add.at(near, (np.arange(len(rows)), label[graph[:, k]]), 1)
    x = np.concatenate([inputs(rows, typical, True), inputs(rows, typical, False)])
    target = np.concatenate([near / near.sum(axis=1, keepdims=True), np.eye(parts)[label]])
    net = {"w1": random.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), "b1": np.zeros(hidden), "w2": random.normal(0, hidden**-0.5, (hidden, parts)), "b2": np.zeros(parts)}
    first, second = {n: 0.0 for n in net}, {n: 0.0 for n in net}
    for step in range(1, max(600, passes * len(x) // 256) + 1):
        at = random.integers(0, len(x), 256)
        inner = np.tanh(x[at] @ net["w1"] + net["b1"])
        error = (softmax(inner @ net["w2"] + net["b2"]) - target[at]) / len(at)
        back = error @ net["w2"].T * (1 - inner**2)
        slope = {"w1": x[at].T @ back, "b1": back.sum(axis=0), "w2": inner.T @ error, "b2": error.sum(axis=0)}
        for n, g in slope.items():
            first[n] = 0.9 * first[n] + 0.1 * g
            second[n] = 0.999 * second[n] + 0.001 * g * g
            net[n] = net[n] - 0.004 * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    return net | {"typical": np.array([typical])}


def route(net: dict[str, np.ndarray], rows: np.ndarray, asks: bool) -> np.ndarray:
    inner = np.tanh(inputs(rows, net["typical"][0], asks) @ net["w1"] + net["b1"])
    return softmax(inner @ net["w2"] + net["b2"])


def exact_products(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, dimension after dimension, whatever the batch."""
    total = np.zeros(len(rows))
    for k in range(rows.shape[1]):
        total += query[k] * rows[:, k]
    return total


def best_of_cell(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query its k best rows: by product, then by smaller id."""
    for a in range(0, len(queries), 256):
        rough = queries[a : a + 256] @ rows.T
        for q, own in enumerate(rough, a):
            near = np.arange(len(own))
            if len(own) > k:
                least = np.partition(own, len(own) - k)[len(own) - k]
                near = np.flatnonzero(own >= least - 1e-9 * (1 + abs(least)))
            score = exact_products(queries[q], rows[near])
            best = np.lexsort((ids[near], -score))[:k]
            yield ids[near[best]], score[best]


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``vec_id, vector`` (doubles), and two hashes of the vector, of the rows that take part."""
    v = F.col(vector)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    own = vectors.where(F.col(id_column).isNotNull() & fine).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(v.cast("array<double>"), lambda x: x + 0.0).alias("vector"))
    return own.select("vec_id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))


def _learn_part(leaf_rows: int, per_part: int):
    def run(table: pa.Table) -> pa.Table:
        part, size = table.column("part")[0].as_py(), table.column("size")[0].as_py()
        rows = np.unique(_vectors(table.column("vector")), axis=0)
        depth = min(int(np.ceil(np.log2(min(FANOUT, max(2, size / leaf_rows))))), int(np.log2(max(1, len(rows) / per_part))))
        if depth < 1:  # too few different vectors to tell parts
            return pa.table({"part": pa.array([], pa.int64()), "net": pa.array([], pa.binary())})
        graph = knn_graph(rows)
        file = io.BytesIO()
        np.savez(file, **train_router(rows, graph, partition_graph(graph, depth), 2**depth))
        return pa.table({"part": pa.array([part], pa.int64()), "net": pa.array([file.getvalue()], pa.binary())})

    return run


def wanted(chance: np.ndarray, sizes: np.ndarray, coverage: float, k: int) -> np.ndarray:
    """Which children each query needs: the most probable ones, until they hold ``coverage`` and more than k rows."""
    order = np.argsort(-chance, axis=1, kind="stable")
    ranked = np.take_along_axis(chance, order, 1)
    before, rows_before = np.cumsum(ranked, axis=1) - ranked, np.cumsum(sizes[order], axis=1) - sizes[order]
    out = np.zeros(chance.shape, dtype=bool)
    np.put_along_axis(out, order, (before < coverage) | (rows_before <= k), 1)
    return out & (sizes > 0)


def _routed(asks: bool, coverage: float, k: int):
    """One group holds some rows of a part, and the part's router if there is one."""

    def run(rows: pa.Table, nets: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.select(names)
        if not nets.num_rows:
            return rows.select(names).append_column("child", rows.column("part")).append_column("chance", pa.array(np.ones(rows.num_rows)))
        net = dict(np.load(io.BytesIO(nets.column("net")[0].as_py())))
        chance = route(net, _vectors(rows.column("vector")), asks)
        base = rows.column("part").to_numpy() * FANOUT + 1
        if asks:
            sizes = np.zeros(chance.shape[1], dtype=np.int64)
            for entry in nets.column("children")[0].as_py():
                sizes[entry["child"] - base[0]] = entry["size"]
            at, child = np.nonzero(wanted(chance, sizes, coverage, k))
        else:
            at, child = np.arange(rows.num_rows), chance.argmax(axis=1)
        return rows.select(names).take(pa.array(at)).append_column("child", pa.array(base[at] + child)).append_column("chance", pa.array(chance[at, child]))

    names = ["h1", "h2"] if asks else ["h1", "h2", "vec_id", "vector"]
    return run


def _step(rows: DataFrame, nets: DataFrame, asks: bool, coverage: float, k: int) -> DataFrame:
    """Rows with ``child`` and ``chance``; of a query its hashes with the children it needs. Router and rows meet in cells."""
    sizes = rows.groupBy("part").agg(F.ceil(F.count("*") / F.lit(CELL_ROWS)).cast("int").alias("cells"))
    cell = F.pmod(F.xxhash64("vec_id", "h1"), F.col("cells")).cast("int")
    dealt = rows.join(sizes, "part").withColumn("cell", cell)
    spread = nets.join(sizes, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), *nets.drop("part").columns)
    schema = f"h1 long, h2 long, {'' if asks else 'vec_id long, vector array<double>, '}child long, chance double"
    return dealt.select("part", "cell", "h1", "h2", "vec_id", "vector").groupBy("part", "cell").cogroup(spread.groupBy("part", "cell")).applyInArrow(_routed(asks, coverage, k), schema)


def partitioned(own: DataFrame, asked: DataFrame, *, k: int, leaf_rows: int, sample: int, per_part: int, coverage: float) -> tuple[DataFrame, DataFrame]:
    """``own`` with its leaf as ``part``, and ``asked`` with a row per leaf to be searched.

    Each round splits the partitions of over ``SPLIT * leaf_rows`` vectors that
    different vectors can split, into parts of about ``leaf_rows`` with at least
    ``per_part`` sampled vectors each. Only the number of those reaches the driver.
    """
    index = own.withColumn("part", F.lit(0).cast("long"))
    route_to = asked.withColumns({"part": F.lit(0).cast("long"), "sure": F.lit(1.0)})
    done = None
    while True:
        sizes = stored(index.groupBy("part").agg(F.count("*").alias("size")))
        large = sizes.where(F.col("size") > SPLIT * leaf_rows)
        large = large.join(done, "part", "left_anti") if done is not None else large
        if large.isEmpty():
            return index, route_to
        picked = index.join(large, "part").where(F.pmod(F.xxhash64("h1", "h2", "vec_id"), F.lit(1_000_000)) < F.least(F.lit(1.0), F.lit(float(sample)) / F.col("size")) * 1_000_000)
        nets = stored(picked.select("part", "size", "vector").groupBy("part").applyInArrow(_learn_part(leaf_rows, per_part), "part long, net binary"))
        failed = large.select("part").join(nets.select("part"), "part", "left_anti")
        done = stored(failed if done is None else done.unionByName(failed))
        index = stored(_step(index, nets, False, coverage, k).select("h1", "h2", "vec_id", "vector", F.col("child").alias("part")))
        held = index.groupBy("part").agg(F.count("*").alias("size"))
        # the chance of a path is the product along it
        known = route_to.select("h1", "h2", F.col("part").alias("from"), "sure")
        # a router and its children's sizes
        parent = F.floor((F.col("part") - 1) / FANOUT).cast("long")
        children = held.where("part > 0").groupBy(parent.alias("part")).agg(F.collect_list(F.struct(F.col("part").alias("child"), "size")).alias("children"))
        stepped = _step(route_to.drop("sure"), nets.join(children, "part"), True, coverage, k)
        came = F.when(F.col("child") == 0, F.lit(0)).otherwise(F.floor((F.col("child") - 1) / FANOUT)).cast("long")
        kept = stepped.join(nets.select(F.col("part").alias("split")), came == F.col("split"), "left")
        kept = kept.withColumn("from", F.when(F.col("split").isNull(), F.col("child")).otherwise(came)).join(known, ["h1", "h2", "from"]).join(held, F.col("child") == F.col("part"))
        order = "PARTITION BY h1, h2 ORDER BY chance * sure DESC, child ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        ranked = kept.withColumns({"before": F.expr(f"coalesce(sum(chance * sure) OVER ({order}), 0)"), "rows_before": F.expr(f"coalesce(sum(size) OVER ({order}), 0)")})
        chosen = ranked.where((F.col("before") < coverage) | (F.col("rows_before") <= k)).select("h1", "h2", F.col("child").alias("part"), (F.col("chance") * F.col("sure")).alias("sure"))
        route_to = stored(chosen.join(asked, ["h1", "h2"]))


def nearest(vectors: DataFrame, *, k: int = 20, every: int = 20, coverage: float = 0.97, leaf_rows: int | None = None, sample: int = 6000, per_part: int = 125, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each queried row.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but the query's own id. Nearness is the inner product in double precision;
    ties go to the smaller id. Vectors that are null, zero, or hold null or
    non-finite components take no part; vectors of one table share one length.
    Repeated rows of one id count once each. An empty table gives no rows.

    Of equal vectors the k + 1 with the smallest ids are candidates: the others
    could only follow them. Equal queries are searched once. A leaf with many rows
    or queries is cut into cells by hashes, so every group of the search is bounded;
    each keeps its k + 1 best per query, and those are merged. Without ``leaf_rows``
    a table has up to 64 leaves of 64 to 2048 rows, then more of them.
    """
    usable_rows = stored(usable(vectors, id_column, vector))
    own = stored(usable_rows.withColumn("_n", F.expr("row_number() OVER (PARTITION BY h1, h2 ORDER BY vec_id)")).where(F.col("_n") <= k + 1).drop("_n"))
    askers = usable_rows.where(F.col("vec_id") % every == 0).select("h1", "h2", F.col("vec_id").alias("query_id"))
    asked = own.withColumn("_n", F.expr("row_number() OVER (PARTITION BY h1, h2 ORDER BY vec_id)")).where("_n = 1").drop("_n").join(askers.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select(*own.columns)
    leaf_rows = leaf_rows or min(2048, max(64, own.count() // FANOUT))
    index, places = partitioned(own, stored(asked), k=k, leaf_rows=leaf_rows, sample=sample, per_part=per_part, coverage=coverage)

    cells = index.groupBy("part").agg(F.ceil(F.count("*") / F.lit(CELL_ROWS)).cast("int").alias("cells"))
    blocks = places.groupBy("part").agg(F.ceil(F.count("*") / F.lit(QUERY_ROWS)).cast("int").alias("blocks"))
    grid = stored(cells.join(blocks, "part"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = index.join(grid, "part").select("part", F.pmod(F.xxhash64("vec_id", "h1"), F.col("cells")).cast("int").alias("cell"), spread("blocks").alias("block"), "h1", "h2", "vec_id", "vector", F.lit(False).alias("asks"))
    wanted = places.join(grid, "part").select("part", spread("cells").alias("cell"), F.pmod(F.xxhash64("h1"), F.col("blocks")).cast("int").alias("block"), "h1", "h2", "vec_id", "vector", F.lit(True).alias("asks"))

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        rows = _vectors(table.column("vector"))
        mine, others = np.flatnonzero(asks), np.flatnonzero(~asks)
        found = [*best_of_cell(rows[mine], rows[others], table.column("vec_id").to_numpy()[others], k + 1)] if len(mine) and len(others) else []
        each = np.repeat(mine[: len(found)], [len(i) for i, _ in found])
        return pa.table({
            "h1": pa.array(table.column("h1").to_numpy()[each]), "h2": pa.array(table.column("h2").to_numpy()[each]),
            "vec_id": pa.array(np.concatenate([i for i, _ in found]) if found else np.zeros(0, dtype=np.int64)),
            "score": pa.array(np.concatenate([s for _, s in found]) if found else np.zeros(0)),
        })

    best = held.unionByName(wanted).groupBy("part", "cell", "block").applyInArrow(search, "h1 long, h2 long, vec_id long, score double")
    # a query's searched groups bring k + 1 rows each; k + 1 of them all are left before anything is gathered
    best = best.withColumn("_n", F.expr("row_number() OVER (PARTITION BY h1, h2 ORDER BY score DESC, vec_id)")).where(F.col("_n") <= k + 1)
    tops = best.groupBy("h1", "h2").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k + 1).alias("top"))
    # many queries may share one vector
    salted = tops.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = askers.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int")).join(salted, ["h1", "h2", "salt"])
    own_top = F.slice(F.filter("top", lambda x: x.vec_id != F.col("query_id")), 1, k)
    ranked = each.select("query_id", F.posexplode(own_top).alias("pos", "hit"))
    return ranked.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score"))
