"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
SLOTS = 1 << 24


@lru_cache(maxsize=8)
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode without it."""
    found = spark.conf.get(SETTING, None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    return _local_folder(spark.sparkContext.applicationId)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The result doesn't depend on any executor, so a lost one costs nothing that
    is already written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/trendmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df``, stored, as the broadcast side of a join if it has at most ``rows`` narrow rows, else as it is."""
    df = stored(df)
    return F.broadcast(df) if df.count() <= rows else df


def join_uneven(rows: DataFrame, table: DataFrame, key: str, size: str, *, least: int = 500, most: int = 100_000) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row per key and the number of the key's rows as ``size``.

    Keys of very many rows don't meet in one task: they are fewer than ``most``, so
    their part of ``table`` is broadcast; the others are joined as the planner likes.
    """
    table = stored(table)
    total = table.agg(F.sum(size)).first()[0] or 0
    often = F.col(size) > max(least, total / most)
    hot = F.broadcast(table.where(often))
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(table.where(often).select(key)), key, "left_anti").join(table.where(~often), key))


def split_by_keys(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``rows`` whose hash ``key`` (a long, never null) may be one of ``keys``, and the others, which surely aren't.

    The keys are marked in a bitmap of 2**24 bits, whatever their number, so wide rows
    that meet no other needn't be shuffled. Rows that are among the first by chance are
    for a join to drop.
    """
    slot = F.pmod(F.col(key), F.lit(SLOTS)) + 1
    marks = F.broadcast(stored(keys.groupBy(F.bitmap_bucket_number(slot).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_marks"))))
    placed = rows.withColumns({"_bucket": F.bitmap_bucket_number(slot), "_place": F.bitmap_bit_position(slot)}).join(marks, "_bucket", "left")
    byte = F.conv(F.hex(F.substring("_marks", (F.col("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.getbit(byte, (F.col("_place") % 8).cast("int")) == 1, F.lit(False))
    return placed.where(marked).select(rows.columns), placed.where(~marked).select(rows.columns)
