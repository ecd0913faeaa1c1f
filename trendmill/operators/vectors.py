"""Vectors: codec, index load, pending work, exact top-k, merging of results."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.model import saved
from .feeds import in_feed


def encode_vector(c: Column) -> Column:
    """``b64:`` and little-endian 32-bit floats; a whole batch is one buffer that is cut at the rows' borders."""

    @F.arrow_udf("binary")
    def packed(batch: pa.Array) -> pa.Array:
        held = batch.cast(pa.list_(pa.float32()))
        sizes = pc.fill_null(pc.list_value_length(held), 0).to_numpy()
        data = held.flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()
        return pa.Array.from_buffers(pa.binary(), len(held), [_valid(held), pa.py_buffer(_offsets(4 * sizes)), pa.py_buffer(data)])

    return F.concat(F.lit("b64:"), F.base64(packed(c)))


def _offsets(sizes: np.ndarray) -> bytes:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32).tobytes()


def _valid(rows: pa.Array) -> pa.Buffer | None:
    """The bits of rows that aren't null."""
    return pa.py_buffer(np.packbits(rows.is_valid().to_numpy(zero_copy_only=False), bitorder="little").tobytes()) if rows.null_count else None


def parse_vector(c: Column) -> Column:
    """Either stored form as array<float>; null for what can't be read."""

    @F.arrow_udf("array<float>")
    def unpacked(batch: pa.Array) -> pa.Array:
        held = batch.cast(pa.large_binary())
        sizes = pc.fill_null(pc.binary_length(held), 0).to_numpy()
        data = b"".join(b.as_buffer() for b in held if b.is_valid)
        values = pa.array(np.frombuffer(data, dtype="<f4"))
        return pa.Array.from_buffers(pa.list_(pa.float32()), len(held), [_valid(held), pa.py_buffer(_offsets(sizes // 4))], children=[values])

    raw = F.when(c.startswith("b64:"), F.try_to_binary(F.substring(c, 5, 1 << 30), F.lit("base64")))
    whole = F.when((F.octet_length(raw) > 0) & (F.octet_length(raw) % 4 == 0), raw)
    listed = F.from_json(F.when(~c.startswith("b64:"), c), "array<float>")
    return F.coalesce(unpacked(whole), F.when(F.size(listed) > 0, listed))


def normalised(c: Column) -> Column:
    """Doubles of length one; the zero vector stays."""
    v = c.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def load_index(products: DataFrame, cap: int = 12000) -> DataFrame:
    """A10: unit vectors of the newest ``cap`` products that have one."""
    own = products.where("embedding IS NOT NULL AND size(embedding) > 0").select("id", "embedding", "last_scraped")
    newest = own.orderBy(F.col("last_scraped").desc_nulls_last(), "id").limit(cap)
    return newest.select("id", normalised(F.col("embedding")).alias("unit"))


def pending(products: DataFrame, result: str, *, force: bool = False, store_id: int | None = None, is_fashion: bool | None = None, limit: int | None = None) -> DataFrame:
    """Rows whose result is missing, newest first."""
    rows = products.where(F.col(result).isNull() | F.lit(force))
    rows = rows if store_id is None else rows.where(F.col("store_id") == store_id)
    rows = rows if is_fashion is None else rows.where(in_feed(is_fashion))
    return rows if limit is None else rows.orderBy(F.col("last_scraped").desc_nulls_last(), "id").limit(limit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


CELL_VALUES = 1 << 20  # numbers in a block's matrix: 8 MB
SCORES = 1 << 20  # numbers that a task scores at once: 8 MB
CENTRES, TOGETHER, ASKED = 256, 8, 2048  # sampled centres; blocks and queries that meet in one task
FOUND = "query_id long, id long, sim double, pairs long, skipped long"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as doubles."""
    rows = column.combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(rows), -1)


def _packed(table: pa.Table) -> pa.Table:
    """A block's rows as one matrix, with its centre and the radius about it."""
    rows = _matrix(table.column("unit"))
    centre = rows.mean(axis=0)
    radius = float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max()))
    return pa.table({"block": table.column("block").slice(0, 1), "cell": table.column("cell").slice(0, 1), "ids": pa.array([table.column("id").to_pylist()], pa.list_(pa.int64())), "matrix": pa.array([rows.tobytes()], pa.binary()), "centre": pa.array([centre], pa.list_(pa.float64())), "radius": [radius]})


def packed_blocks(index: DataFrame, *, values: int = CELL_VALUES, centres: int = CENTRES) -> DataFrame:
    """Blocks of ``index(id, unit)``: rows near the same one of a few sampled rows, cut by hash to a bounded size.

    All vectors have one length. The sampled centres (at most ``centres`` rows) are all
    that reaches the driver.
    """
    chosen = [r["unit"] for r in index.orderBy(F.xxhash64("id"), "id").limit(centres).collect()]
    if not chosen:
        return index.sparkSession.createDataFrame([], "block int, cell int, ids array<long>, matrix binary, centre array<double>, radius double")
    about = np.array(chosen, dtype=np.float64)[: max(1, len(chosen) // 4)]

    @F.arrow_udf("int")
    def nearest(rows: pa.Array) -> pa.Array:
        return pa.array((_matrix(pa.chunked_array([rows])) @ about.T).argmax(axis=1).astype(np.int32))

    dealt = index.select("id", "unit", nearest("unit").alias("block"))
    size = max(16, values // about.shape[1])
    cells = dealt.groupBy("block").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("cells"))
    # one row per centre
    own = dealt.join(F.broadcast(cells), "block").withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"))
    return own.groupBy("block", "cell").applyInArrow(_packed, "block int, cell int, ids array<long>, matrix binary, centre array<double>, radius double")


def _search(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        none = {"query_id": [], "id": [], "sim": [], "pairs": [], "skipped": []}
        if not blocks.num_rows or not asked.num_rows:
            return pa.table({n: pa.array(v, kind) for (n, v), kind in zip(none.items(), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)})
        q, centre = _matrix(asked.column("q")), _matrix(blocks.column("centre"))
        radius = blocks.column("radius").to_numpy()
        bound = q @ centre.T + np.linalg.norm(q, axis=1)[:, None] * radius
        best = np.full((len(q), k), -np.inf)
        ids = np.full((len(q), k), np.iinfo(np.int64).max)
        skipped = 0
        for c in np.argsort(-bound.max(axis=0), kind="stable").tolist():
            active = np.flatnonzero(bound[:, c] >= best[:, -1] - 1e-9)
            skipped += len(q) - len(active)
            if not len(active):
                continue
            rows = np.frombuffer(blocks.column("matrix")[c].as_buffer(), dtype=np.float64).reshape(-1, q.shape[1])
            names = blocks.column("ids")[c].values.to_numpy()
            step = max(1, SCORES // len(names))
            for part in (active[a : a + step] for a in range(0, len(active), step)):
                scores = np.round(q[part] @ rows.T, 12)  # equal vectors tie wherever they stand
                for at, own in zip(part.tolist(), scores, strict=True):
                    near = np.flatnonzero(own >= best[at, -1])
                    if len(near):
                        both, of = np.concatenate([best[at], own[near]]), np.concatenate([ids[at], names[near]])
                        order = np.lexsort((of, -both))[:k]
                        best[at], ids[at] = both[order], of[order]
        real = np.isfinite(best)
        row = np.nonzero(real)[0]
        total = int(real.sum())
        told = lambda v: pa.concat_arrays([pa.array(v), pa.nulls(1, pa.array(v).type)])
        tell = lambda v: pa.concat_arrays([pa.nulls(total, pa.int64()), pa.array([v], pa.int64())])
        return pa.table({"query_id": told(asked.column("query_id").to_numpy()[row]), "id": told(ids[real]), "sim": told(best[real]), "pairs": tell(len(q) * len(radius)), "skipped": tell(skipped)})

    return run


def searched_blocks(blocks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``FOUND``: per task the best ``k`` rows of each query, and a row without query that tells how many pairs of query and block there were and were skipped.

    A group of blocks meets a group of queries in one task, blocks of the highest
    bound first. A block whose centre and radius can't give more than a query's
    k-th best so far is skipped for it. Nothing is broadcast, and no pair of rows leaves
    a task but the best. Scores are made in slices of ``SCORES``, so a task's memory is
    that of its blocks and queries.
    """
    asked = queries.where(F.exists("unit", lambda x: x != 0)).select("query_id", F.col("unit").cast("array<double>").alias("q"))
    n_blocks, n_asked = blocks.count(), asked.count()
    groups, parts = -(-n_blocks // TOGETHER) or 1, -(-n_asked // ASKED) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = blocks.withColumn("_g", F.pmod(F.xxhash64("block", "cell"), F.lit(groups)).cast("int")).withColumn("_p", every(parts))
    right = asked.withColumn("_p", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).withColumn("_g", every(groups))
    return left.groupBy("_g", "_p").cogroup(right.groupBy("_g", "_p")).applyInArrow(_search(k), FOUND)


def vector_top_k(index: DataFrame, queries: DataFrame, k: int = 200, scope: DataFrame | None = None) -> DataFrame:
    """``query_id, id, sim, rank`` of the best ``k`` per query, exactly.

    ``queries(query_id, unit)`` is the stated query set; blocks of ``index`` that can't
    matter are skipped. Rank goes by the product to 12 places, ``sim`` is rounded to 6;
    ties go to the smaller id. A zero query gives no rows, null vectors take no part.
    """
    rows = (index if scope is None else index.join(scope, "id", "left_semi")).where("unit IS NOT NULL").select("id", F.col("unit").cast("array<double>").alias("unit"))
    found = searched_blocks(saved(packed_blocks(saved(rows))), queries, k).where("query_id IS NOT NULL")
    best = found.select("query_id", "id", "sim").withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id)")).where(F.col("rank") <= k)
    return best.withColumn("sim", F.round("sim", 6))


def merge_results(products: DataFrame, results: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """K7: non-null results replace the old values; other rows stay as they are."""
    renamed = results.select("id", *(F.col(c).alias(f"_{c}") for c in columns))
    joined = products.join(renamed, "id", "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) if c in products.columns else F.col(f"_{c}") for c in columns}).drop(*(f"_{c}" for c in columns))
