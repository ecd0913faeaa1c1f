"""Next states of the tables: upsert, sweeps, retirement, stores, deletes.

Every function returns complete next tables; ``write_state`` makes one visible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import reject_reason, store_url, text_or_empty
from . import labels as L
from . import rules as R
from .commits import complete_versions, write_part
from .sides import checked, merged

OVERWRITTEN = ("title", "handle", "image_url", "price", "vendor", "product_type", "ai_tags", "current_position", "is_fashion", "subniche")


def active() -> Column:
    return F.col("is_fashion") | (F.col("subniche") != "")


def retired(df: DataFrame, when: Column) -> DataFrame:
    return df.withColumns({"is_fashion": F.when(when, False).otherwise(F.col("is_fashion")), "subniche": F.when(when, "").otherwise(F.col("subniche"))})


def last_listed(scraped: DataFrame) -> DataFrame:
    """One row per store and handle: the one listed last, where general lists follow fashion ones and later places earlier ones."""
    columns = [c for c in scraped.columns if c not in ("store_id", "handle")]
    order = F.struct((~F.coalesce("is_fashion", F.lit(False))).alias("general"), "current_position", F.xxhash64(*columns).alias("tie"))
    return scraped.groupBy("store_id", "handle").agg(F.max_by(F.struct(*columns), order).alias("_row")).select("store_id", "handle", "_row.*")


def upsert_products(products: DataFrame, scraped: DataFrame, *, now: str, tables: R.Tables = R.SAMPLE) -> DataFrame:
    """Match on store and handle; the scrape's attributes win, vectors and vision times stay.

    A handle that a scrape lists more than once counts as it is listed last.
    ``existed`` tells old rows, ``listed`` those of this scrape. A new row's id
    follows from store and handle. The category is assigned anew for listed rows; a
    row that the scrape marks ``vision_classified`` gets its time.
    """
    taken = [c for c in (*OVERWRITTEN, "product_url") if c != "handle" and c in scraped.columns and c in products.columns]
    seen = F.coalesce("vision_classified", F.lit(False)) if "vision_classified" in scraped.columns else F.lit(False)
    fresh = last_listed(scraped).select("store_id", F.col("handle").alias("_key"), *(F.col(c).alias(f"_{c}") for c in taken), seen.alias("_seen"), F.lit(True).alias("_listed"))
    old = products.withColumns({"_key": F.col("handle"), "_existed": F.lit(True)})
    both = merged(old).join(fresh, ["store_id", "_key"], "full_outer")  # a right join where only listed rows are wanted
    listed, at = F.coalesce("_listed", F.lit(False)), F.lit(now).cast("timestamp_ntz")
    more = {c: F.when(listed, F.col(f"_{c}")).otherwise(F.col(c)) for c in taken}
    if "vision_classified_at" in products.columns:
        more["vision_classified_at"] = F.when(F.col("_seen"), at).otherwise(F.col("vision_classified_at"))
    own = both.withColumns(more | {"handle": F.col("_key"), "id": F.coalesce("id", F.abs(F.xxhash64("store_id", "_key"))), "existed": F.coalesce("_existed", F.lit(False)), "listed": listed, "last_scraped": F.when(listed, at).otherwise(F.col("last_scraped"))})
    own = own.withColumn("product_category", F.when(listed, R.assign_category(own, tables.catalog)).otherwise(F.col("product_category")))
    return own.select(*products.columns, "existed", "listed")


def _within(hit: Column, among: Column | None) -> Column:
    return hit if among is None else hit & among


def sweep_junk(products: DataFrame, among: Column | None = None, tables: R.Tables = R.SAMPLE) -> DataFrame:
    """Active junk is retired."""
    return retired(products, _within(active() & R.is_junk(products, tables.junk), among))


def sweep_demote(products: DataFrame, among: Column | None = None, tables: R.Tables = R.SAMPLE) -> DataFrame:
    """Fashion rows of general purpose move to the general feed."""
    hit = _within(F.col("is_fashion") & R.forced_general(products, tables.general), among)
    return products.withColumns({"subniche": F.when(hit, R.general_subniche(F.col("title"), tables.subniches)).otherwise(F.col("subniche")), "is_fashion": F.when(hit, False).otherwise(F.col("is_fashion"))})


def sweep_promote(products: DataFrame, among: Column | None = None, tables: R.Tables = R.SAMPLE) -> DataFrame:
    """Other rows that are apparel move to fashion; wearable subniches stay. Junk isn't tested again."""
    hit = ~F.col("is_fashion") & R.forced_fashion(products, tables.fashion) & ~R.forced_general(products, tables.general)
    return promoted(products, _within(hit, among))


def promoted(products: DataFrame, hit: Column) -> DataFrame:
    sub = F.when(hit & ~F.col("subniche").isin(*R.WEARABLE), "fashion").otherwise(F.col("subniche"))
    return products.withColumns({"subniche": sub, "is_fashion": F.when(hit, True).otherwise(F.col("is_fashion"))})


def sweep_off_cap(products: DataFrame, cap: int = 600, among: Column | None = None) -> DataFrame:
    """Active rows beyond the source cap are retired."""
    return retired(products, _within(active() & (F.col("current_position") > cap), among))


def _retire_unlisted(products: DataFrame, listed: Column, scraped: DataFrame, guard: int) -> DataFrame:
    """Two counts per store of the scrape decide; they are broadcast after a check of their number."""
    sizes = scraped.groupBy("store_id").agg(F.count_if(F.col("is_fashion")).alias("_nf"), F.count_if(~F.col("is_fashion")).alias("_ng"))
    own = products.join(checked(sizes), "store_id", "left")
    enough = F.when(F.col("is_fashion"), F.col("_nf")).otherwise(F.col("_ng")) >= guard
    return retired(own, active() & ~listed & F.coalesce(enough, F.lit(False))).drop("_nf", "_ng")


def retire_absent(products: DataFrame, scraped: DataFrame, guard: int = 5) -> DataFrame:
    """Rows of a feed that the store's scrape doesn't list are retired, if that feed's list has ``guard`` rows."""
    listed = scraped.select("store_id", "handle").distinct().withColumn("_in", F.lit(True))
    return _retire_unlisted(products.join(listed, ["store_id", "handle"], "left"), F.col("_in").isNotNull(), scraped, guard).select(*products.columns)


def promote_wearables(products: DataFrame) -> DataFrame:
    """G9"""
    return products.withColumn("is_fashion", F.col("is_fashion") | F.col("subniche").isin("bags", "accessories", "jewelry"))


def backfill_category(products: DataFrame, tables: R.Tables = R.SAMPLE) -> DataFrame:
    """G10"""
    return products.withColumn("product_category", F.when(text_or_empty(F.col("product_category")) == "", R.assign_category(products, tables.catalog)).otherwise(F.col("product_category")))


def force_promote(products: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of ``chosen``, by ``id`` and ``handle`` where given, go to fashion, with their state before and after."""
    keys = [products.join(chosen.select(k).where(F.col(k).isNotNull()), k, "left_semi").select(*products.columns) for k in ("id", "handle") if k in chosen.columns]
    own = keys[0] if len(keys) == 1 else keys[0].unionByName(keys[1].join(chosen.select("id"), "id", "left_anti").select(*products.columns))
    after = promoted(own.withColumns({"before_fashion": F.col("is_fashion"), "before_subniche": F.col("subniche")}), F.lit(True))
    return after.select("id", "handle", "before_fashion", "before_subniche", F.col("is_fashion").alias("after_fashion"), F.col("subniche").alias("after_subniche"))


def apply_scrape(products: DataFrame, scraped: DataFrame, *, now: str, cap: int = 600, guard: int = 5, tables: R.Tables = R.SAMPLE) -> DataFrame:
    """Sanitise, upsert, then the sweeps over rows that existed before, then retirement, in this order.

    ``apply_run`` adds the snapshots and the movement events.
    """
    clean = scraped.withColumn("subniche", R.sane_subniche(F.col("is_fashion"), F.col("subniche")))
    state, old = upsert_products(products, clean, now=now, tables=tables), F.col("existed")
    state = sweep_promote(sweep_demote(sweep_junk(state, old, tables), old, tables), old, tables)
    return _retire_unlisted(sweep_off_cap(state, cap, old), F.col("listed"), clean, guard).select(*products.columns, "listed")


def apply_run(products: DataFrame, history: DataFrame, ledger: DataFrame, scraped: DataFrame, *, now: str, epoch: str, start: str, cap: int = 600, guard: int = 5, tables: R.Tables = R.SAMPLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Next products (with ``listed``), the snapshots to append, and the next ledger of one run."""
    state = apply_scrape(products, scraped, now=now, cap=cap, guard=guard, tables=tables)
    return state, append_history(state, now=now), L.merge_events(ledger, L.events_of_today(state, history, now=now, epoch=epoch, start=start))


def sweep_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows touched, retired, promoted and demoted between two states."""
    old = before.select("id", F.col("is_fashion").alias("of"), F.col("subniche").alias("os"))
    both = after.join(old, "id")
    gone = ~active() & (F.col("of") | (F.col("os") != ""))
    return both.agg(F.count_if((F.col("is_fashion") != F.col("of")) | (F.col("subniche") != F.col("os"))).alias("touched"), F.count_if(gone).alias("retired"),
                    F.count_if(F.col("is_fashion") & ~F.col("of")).alias("promoted"), F.count_if(~F.col("is_fashion") & F.col("of") & active()).alias("demoted"))


def append_history(state: DataFrame, *, now: str) -> DataFrame:
    """A snapshot of every listed row."""
    return state.where("listed").select(F.col("id").alias("product_id"), "store_id", F.col("current_position").alias("position"), F.lit(now).cast("timestamp_ntz").alias("date"))


def upsert_stores(stores: DataFrame, changes: DataFrame) -> DataFrame:
    """Each change as ``accepted``, ``rejected`` or ``conflict``, with its clean address.

    An absent (null) field of an update keeps its value; an address that another
    store has is a conflict.
    """
    old = stores.select(F.col("id").alias("_id"), F.col("name").alias("_name"), F.col("url").alias("_url"))
    own = changes.join(old, F.col("id") == F.col("_id"), "left")
    own = own.select("id", F.coalesce("name", "_name").alias("name"), F.coalesce("url", "_url").alias("url"))
    own = own.withColumns({"reason": reject_reason(F.col("name"), F.col("url")), "clean": store_url(F.col("url"))})
    taken = stores.select(store_url(F.col("url")).alias("clean"), F.col("id").alias("_owner"))
    conflict = own.join(taken, "clean").where("id IS NULL OR id <> _owner").select(F.col("id").alias("_cid"), F.col("clean").alias("_cclean")).distinct().withColumn("_taken", F.lit(True))
    found = own.join(conflict, (F.col("clean") == F.col("_cclean")) & F.col("id").eqNullSafe(F.col("_cid")), "left").select("id", "name", F.col("clean").alias("url"), "reason", "_taken")
    status = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("_taken"), "conflict").otherwise("accepted")
    return found.select("id", F.trim("name").alias("name"), "url", status.alias("status"), "reason")


def delete_store(store_id: int, stores: DataFrame, products: DataFrame, history: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """The four tables without a store and all that hangs on it."""
    gone = products.where(F.col("store_id") == store_id).select(F.col("id").alias("product_id"))
    return {"stores": stores.where(F.col("id") != store_id), "products": products.where(F.col("store_id") != store_id), "history": history.join(gone, "product_id", "left_anti"), "events": events.where(F.col("store_id") != store_id).join(gone, "product_id", "left_anti")}


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its count."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def orphans(stores: DataFrame, products: DataFrame, history: DataFrame, events: DataFrame) -> DataFrame:
    """How many rows of each table have no parent."""
    no_store = products.join(stores.select(F.col("id").alias("store_id")), "store_id", "left_anti")
    owned = products.select(F.col("id").alias("product_id"))
    return row_counts({"products": no_store, "history": history.join(owned, "product_id", "left_anti"), "events": events.join(owned, "product_id", "left_anti")})


def reset(products: DataFrame, history: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """Empty derived tables; stores aren't touched."""
    return {"products": products.where("false"), "history": history.where("false"), "events": events.where("false")}


def seed_if_empty(stores: DataFrame, initial: DataFrame) -> DataFrame:
    """The initial stores if there is none, else the stores as they are."""
    return initial.select(*stores.columns) if stores.isEmpty() else stores


def maintain(products: DataFrame, tables: R.Tables = R.SAMPLE) -> DataFrame:
    """The whole-table maintenance chain; demotion after promotion, so that function beats form."""
    own = promote_wearables(sweep_junk(products, None, tables))
    return backfill_category(sweep_off_cap(sweep_demote(sweep_promote(own, None, tables), None, tables)), tables)


def write_history(snapshots: DataFrame, path: str, run: str) -> None:
    """Append a run's snapshots, partitioned by run and day; a run that is written again replaces its own rows only."""
    folder, _, table = path.rstrip("/").rpartition("/")
    write_part(snapshots.withColumn("day", F.to_date("date")), folder, table, run, partition_by="day")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The snapshots of all runs, with ``run`` and ``day``."""
    return spark.read.parquet(path).withColumn("run", F.col("run").cast("string"))


def write_bucketed(df: DataFrame, table: str, path: str, key: str = "product_id", buckets: int = 64) -> DataFrame:
    """A table dealt into buckets of ``key`` in the shared folder, so that what is grouped or joined by it isn't shuffled again."""
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def write_state(df: DataFrame, path: str, version: int, partition_by: str | None = None, order_by: tuple[str, ...] = ()) -> str:
    """A version directory; readers switch when it is complete. A repeated run writes it anew. Returns its path.

    ``partition_by`` makes a folder per value and is for few values, such as days.
    ``order_by`` is for keys that grow with the table, such as stores: the files hold
    ranges of it, so a reader of one key skips the others by their footers.
    """
    out = f"{path.rstrip('/')}/version={version}"
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by) if order_by else df
    writer = (ranged.repartition(partition_by) if partition_by and not order_by else ranged).write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(out)
    return out


def newest_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest version, or the newest before one, that was written to its end; None if there is none."""
    done = complete_versions(spark, path)
    versions = [v for v in done if before is None or v < before]
    return spark.read.parquet(done[max(versions)]) if versions else None
