"""Incremental runs over snapshot files, as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from ..operators import labels as L

SNAPSHOT = "id long, product_id long, store_id long, position int, date timestamp"
MOVEMENT = "store_id long, product_id long, date date, label string, prior_position int, current_position int, position_change int"
MOVEMENT_COLUMNS = ["store_id", "product_id", "date", "label", "prior_position", "current_position", "position_change"]
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot files as they arrive."""
    return spark.readStream.schema(SNAPSHOT).parquet(path)


def closing_snapshots(rows: DataFrame, date: str = "2200-01-01") -> DataFrame:
    """A last snapshot of every product, far ahead: it ends a stream by closing all its days, and yields no row itself."""
    own = rows.select("product_id", "store_id").distinct()
    return own.select(F.lit(None).cast("long").alias("id"), "product_id", "store_id", F.lit(0).alias("position"), F.lit(date).cast("timestamp").alias("date"))


def ingest(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """L1: run ``apply(batch, batch_id)`` over all that is there, once; a repeated id must have the same effect."""
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def daily_last_stream(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """L2: the last position of each product and day; a day is final when the watermark has passed it."""
    days = stream.withWatermark("date", late).groupBy("product_id", F.window("date", "1 day").alias("w"))
    return days.agg(F.max_by("position", "date").alias("position")).select("product_id", F.to_date("w.start").alias("date"), "position")


class DailyMovements(StatefulProcessor):
    """L3 for one bucket of products: the last closed day of each and its position.

    Rows are closed days, each product's once and in order from batch to batch. A day
    is compared with the one before, unless that is more than ``keep`` days older;
    products without a day for that long are forgotten. A batch of a bucket is one
    table, so the number of calls doesn't grow with the products.
    """

    STATE = "product_id array<bigint>, day array<int>, position array<int>"

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.closed = handle.getValueState("closed", self.STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(rows, ignore_index=True)
        before = dict(zip(("product_id", "day", "position"), self.closed.get(), strict=True)) if self.closed.exists() else {}
        known = pd.DataFrame(before, columns=["product_id", "day", "position"], dtype="int64")
        own = new[["product_id", "day", "position"]].astype("int64")
        days = pd.concat([known.assign(row=-1), own.assign(row=range(len(own)))], ignore_index=True).sort_values(["product_id", "day"])
        days["prior"] = days.groupby("product_id")["position"].shift(fill_value=0)
        gap = days["day"] - days.groupby("product_id")["day"].shift(fill_value=-(1 << 30))
        days.loc[gap > self.keep, "prior"] = 0
        last = days.drop_duplicates("product_id", keep="last")
        last = last[last["day"] >= last["day"].max() - self.keep]
        self.closed.update(tuple(last[c].tolist() for c in ("product_id", "day", "position")))
        days = days[days["row"] >= 0].sort_values("row").reset_index(drop=True)
        change = days["prior"] - days["position"]
        moved = (days["prior"] != 0) & (days["position"] != 0) & (change != 0) & (change.abs() <= new["threshold"])
        label = (change > 0).map({True: "hero", False: "villain"})
        found = pd.DataFrame({"store_id": new["store_id"], "product_id": days["product_id"], "date": new["date"], "label": label, "prior_position": days["prior"], "current_position": days["position"], "position_change": change})
        yield found[moved][MOVEMENT_COLUMNS]

    def close(self) -> None:
        pass


def movement_stream(stream: DataFrame, products: DataFrame, *, start: str, late: str = "6 hours", keep: int = 30, buckets: int = 1024) -> DataFrame:
    """L3: hero and villain events between observed days at or after ``start``, as days close; they equal H4's.

    A day closes by time, when the watermark has passed its end (L2); a later snapshot
    of it is dropped. Only closed days reach the comparison, in ``buckets`` of
    products, a number that stays for a checkpoint. Moves beyond the threshold of the
    product's catalog (H1) are none; catalog sizes come from ``products`` by a join.
    Snapshots of products that aren't there are dropped. Needs the RocksDB state store.
    """
    sized = products.select(F.col("id").alias("product_id"), "store_id", "is_fashion").join(L.catalog_sizes(products), ["store_id", "is_fashion"], "left")
    known = sized.select("product_id", "store_id", L.threshold(F.coalesce("size", F.lit(0))).cast("int").alias("threshold"))
    days = daily_last_stream(stream.where(F.col("date") >= F.lit(start).cast("timestamp")), late)
    own = days.join(known, "product_id").select("*", F.unix_date("date").alias("day"), F.pmod(F.xxhash64("product_id"), F.lit(buckets)).alias("bucket"))
    return own.groupBy("bucket").transformWithStateInPandas(DailyMovements(keep), MOVEMENT, "append", "None")
