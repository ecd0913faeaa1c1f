"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions.

A source's documents, in the order of a hash of their ids, form blocks. With the
integer weight w of a source and the sum n of all weights, block k of a period is
released at slot floor(k * n / w) and due before slot ceil((k + 1) * n / w). Of the
released blocks the one due first takes the slot. Each source then is less than
one block away from its share at every slot. The schedule repeats after n slots,
so one period is planned, from the weights alone, and all blocks are placed by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small

BLOCK_DOCS = 64
BUCKET_DOCS = 2_000
NO_SOURCE = "(none)"


def root_weights(docs: DataFrame, *, parts: int = 100) -> DataFrame:
    """``source, weight``: shares of about ``parts`` by the square roots of the sources' sizes, 1 at least."""
    counts = docs.groupBy(F.coalesce("source", F.lit(NO_SOURCE)).alias("source")).count()
    total = counts.agg(F.sum(F.sqrt("count")).alias("total"))
    # one row
    return counts.crossJoin(F.broadcast(total)).select("source", F.greatest(F.lit(1), F.round(parts * F.sqrt("count") / F.col("total"))).cast("int").alias("weight"))


def period_plan(weights: DataFrame) -> DataFrame:
    """``source, weight, period, turn, slot``: the slot of each of a source's blocks in one period.

    Earliest deadline first over released blocks; ties go to the first source in
    alphabetical order. ``weights`` is a small table of the user's: one row is made of
    it, and planning takes as many steps as sources times their summed weights.
    """
    listed = weights.where("weight > 0").agg(F.sort_array(F.collect_list(F.struct("source", "weight"))).alias("all"))
    listed = listed.where("size(all) > 0").select("all", F.expr("transform(all, x -> cast(x.weight AS BIGINT))").alias("w")).withColumn("period", F.expr("aggregate(w, 0L, (a, x) -> a + x)"))
    planned = listed.withColumn(
        "plan",
        F.expr("""aggregate(sequence(0L, period - 1),
          named_struct('done', transform(w, x -> 0L), 'slots', cast(array() AS ARRAY<INT>)),
          (a, t) -> transform(
            array(array_min(transform(
              filter(sequence(0, size(w) - 1), j -> get(a.done, j) < get(w, j) AND get(a.done, j) * period div get(w, j) <= t),
              j -> named_struct('due', ((get(a.done, j) + 1) * period + get(w, j) - 1) div get(w, j), 'j', j))).j),
            p -> named_struct('done', transform(a.done, (d, i) -> d + if(i = p, 1L, 0L)), 'slots', concat(a.slots, array(p))))[0],
          a -> a.slots)"""),
    )
    rows = planned.select("all", "period", F.posexplode("plan").alias("slot", "j")).select(F.expr("all[j].source").alias("source"), F.expr("all[j].weight").alias("weight"), "period", "slot")
    return rows.withColumn("turn", F.expr("row_number() OVER (PARTITION BY source ORDER BY slot) - 1"))


def mix_sources(docs: DataFrame, weights: DataFrame, *, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """All columns of ``docs`` and ``block``, ``slot``, ``position`` (long).

    ``position`` orders the mixture. Every row is kept: a source that ends early
    leaves its later slots empty and the others go on at their relative rates. A
    null source is the source ``(none)``; rows of a source without a positive weight
    follow after all others, with a null slot and position, which sort last here.
    Documents of a source are ordered by the md5 of their ids, then by id; equal
    rows share any of their places. An empty table gives no rows, other columns may
    have any names but those three, which are replaced.

    A hot source is ranked in buckets of about 2,000 documents: only the buckets'
    sizes are summed up per source. Tables of sources and of the plan are broadcast
    if they are small, else joined by shuffles.
    """
    deep = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in docs.columns))  # no column of docs begins so
    source, order, bucket, buckets, before, rank, weight, period, turn, slot = (deep + n for n in ("source", "order", "bucket", "buckets", "before", "rank", "weight", "period", "turn", "slot"))
    key = F.coalesce("source", F.lit(NO_SOURCE))
    own = docs.drop("block", "slot", "position").withColumns({source: key, order: F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))})
    cut = F.conv(F.substring(order, 1, 7), 16, 10).cast("long")
    sizes = docs.groupBy(key.alias(source)).agg(F.ceil(F.count("*") / F.lit(BUCKET_DOCS)).alias(buckets))
    own = own.join(small(sizes), source).withColumn(bucket, F.floor(cut * F.col(buckets) / F.lit(1 << 28)).cast("int"))
    counts = own.groupBy(source, bucket).agg(F.count("*").alias(rank))
    upto = counts.select(source, bucket, F.expr(f"coalesce(sum({rank}) OVER (PARTITION BY {source} ORDER BY {bucket} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias(before))
    ranked = own.withColumn(rank, F.expr(f"row_number() OVER (PARTITION BY {source}, {bucket} ORDER BY {order}, doc_id) - 1")).join(upto, [source, bucket])
    ranked = ranked.withColumn(rank, F.col(rank) + F.col(before)).withColumn("block", F.floor(F.col(rank) / block_docs).cast("long"))
    plan = small(period_plan(weights).select(F.col("source").alias(source), F.col("weight").alias(weight), F.col("period").alias(period), F.col("turn").alias(turn), F.col("slot").cast("long").alias(slot)))
    rates = small(plan.groupBy(source).agg(F.first(weight).alias(weight), F.first(period).alias(period)))
    placed = ranked.join(rates, source, "left").withColumn(turn, F.col("block") % F.col(weight)).join(plan.select(source, turn, slot), [source, turn], "left")
    placed = placed.withColumn("slot", (F.floor(F.col("block") / F.col(weight)) * F.col(period) + F.col(slot)).cast("long"))
    placed = placed.withColumn("position", F.col("slot") * block_docs + F.col(rank) % block_docs)
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("block", "slot", "position")], "block", "slot", "position")


def in_mixed_order(mixed: DataFrame) -> DataFrame:
    """Rows in the order of the mixture, over range partitions."""
    return mixed.orderBy(F.col("position").asc_nulls_last())
