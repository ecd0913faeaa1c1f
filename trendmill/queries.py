"""The library's operators over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import labels as L
from .operators import state as S
from .registry import ORACLES, QUERIES
from .sources import model as M
from .sources.model import NOW, PRELUDE, START, TODAY

FLOORS = {"now": NOW, "epoch": START, "start": START}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            sql_ = sql.strip()
            again = "RECURSIVE " * sql_.startswith("WITH RECURSIVE ")
            ORACLES[name] = f"WITH {again}{PRELUDE}{', ' + sql_[5 + len(again):] if sql_.startswith('WITH ') else sql_}"
        return function

    return add


def tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return M.stores(spark, folder), M.products(spark, folder), M.history(spark, folder)


def run_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Stores, products, history and ledger; the model is derived once and written, as a run would leave it."""
    stores, products, history = tables(spark, folder)
    products, history = M.saved(products), M.saved(history)
    return stores, products, history, M.saved(ledger_of(products, history))


def ledger_of(products: DataFrame, history: DataFrame) -> DataFrame:
    """Backfilled events and those of today; the latter are written first, as the merge reads them twice."""
    today = M.saved(L.events_of_today(products, history, **FLOORS))
    return L.merge_events(L.backfill_events(products, history, None, now=NOW, start=START), today)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    return run_tables(spark, folder)[3]


@query("h1_threshold", "SELECT p_partkey, CASE WHEN p_size - 3 <= 0 THEN 30 ELSE least(30, greatest(1, CAST(floor(0.3 * (p_size - 3)) AS INT))) END AS threshold FROM part")
def h1(spark, folder):
    return M.read(spark, folder, "part").select("p_partkey", L.threshold(F.col("p_size") - 3).alias("threshold"))


@query("h2_movement_labels", "SELECT id, store_id, current_position, label, change AS position_change, prior_position FROM labels_now")
def h2(spark, folder):
    _, products, history = tables(spark, folder)
    return L.movement_labels(products, history, **FLOORS).select("id", "store_id", "current_position", "label", "position_change", "prior_position")


@query("h3_events_of_today", "SELECT * FROM ledger WHERE date = DATE '2024-01-30'")
def h3(spark, folder):
    _, products, history = tables(spark, folder)
    return L.events_of_today(products, history, **FLOORS)


@query("h3_merged_ledger", "SELECT * FROM ledger")
def h3m(spark, folder):
    _, products, history, events = run_tables(spark, folder)
    return L.merge_events(events, L.events_of_today(products, history, **FLOORS))


@query("h4_event_backfill", "SELECT * FROM ledger WHERE date < DATE '2024-01-30'")
def h4(spark, folder):
    _, products, history = tables(spark, folder)
    return L.backfill_events(products, history, None, now=NOW, start=START)


@query("h4_c10_backfill_of_gaps", "SELECT * FROM ledger WHERE date < DATE '2024-01-30' AND NOT (product_id % 2 = 0 AND date < DATE '2024-01-20')")
def h4gap(spark, folder):
    _, products, history = tables(spark, folder)
    known = ledger(spark, folder).where("product_id % 2 = 0 AND date < DATE'2024-01-20'")
    return L.backfill_events(products, history, known, now=NOW, start=START)


@query("h5_event_retention", "SELECT * FROM ledger WHERE CAST(date AS TIMESTAMP) >= TIMESTAMP '2024-01-30 18:00:00' - INTERVAL 10 DAYS")
def h5(spark, folder):
    return L.keep_recent(ledger(spark, folder), now=NOW, days=10)


@query("h6_pre_floor_purge", "SELECT * FROM ledger WHERE date >= DATE '2024-01-15'")
def h6(spark, folder):
    return L.drop_before(ledger(spark, folder), "2024-01-15")


_H7 = "SELECT e.product_id, e.date, e.label, e.prior_position, e.current_position AS event_position, e.position_change FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY date DESC) AS rn FROM ledger WHERE label = '{label}' AND date >= DATE '2024-01-24') e JOIN products p ON p.id = e.product_id WHERE rn = 1"
_EVENT = ["product_id", "date", "label", "prior_position", "event_position", "position_change"]


@query("h7_event_window_heroes", _H7.format(label="hero") + " AND is_fashion")
def h7(spark, folder):
    _, products, _, events = run_tables(spark, folder)
    return L.event_window(events, products, label="hero", days=7, now=NOW, start=START, is_fashion=True).select(_EVENT)


@query("h7_event_window_all_villains", _H7.format(label="villain"))
def h7v(spark, folder):
    _, products, _, events = run_tables(spark, folder)
    return L.event_window(events, products, label="villain", days=7, now=NOW, start=START).select(_EVENT)


@query("h8_trusted_snapshots", f"SELECT * FROM history WHERE CAST(date AS DATE) < DATE '{TODAY}' AND date >= DATE '{START}'")
def h8(spark, folder):
    return M.history(spark, folder).where(L.trusted(NOW, START, START))


for _label in ("hero", "villain", "normal", "new"):

    @query(f"h9_label_filter_{_label}", f"SELECT id, prior_position, current_position FROM labels_now WHERE label = '{_label}'" + " AND prior_position = current_position" * (_label == "normal"))
    def h9(spark, folder, label=_label):
        _, products, history = tables(spark, folder)
        return L.label_filter(L.movement_labels(products, history, **FLOORS), label).select("id", "prior_position", "current_position")


@query("c2_e1_prior_positions", "SELECT product_id AS id, prior FROM prior")
def c2(spark, folder):
    return L.prior_positions(M.history(spark, folder), **FLOORS)


@query("c2_e3_bucketed_history", "SELECT product_id, count(*) AS days, arg_max(position, dt) AS last_position, any_value(prior) AS prior FROM daily LEFT JOIN prior USING (product_id) GROUP BY 1")
def c2b(spark, folder):
    """Priors and daily lasts of a history that is stored in buckets: neither shuffles it, nor does their join."""
    stored = bucketed_history(spark, folder)
    days = L.daily_last(stored.where(L.trusted(NOW, START, START))).groupBy("product_id").agg(F.count("*").alias("days"), F.max_by("position", "date").alias("last_position"))
    priors = L.prior_positions(stored, **FLOORS).withColumnRenamed("id", "product_id")
    return days.join(priors, "product_id", "left")


def bucketed_history(spark: SparkSession, folder: str) -> DataFrame:
    path = M.new_folder(spark)
    return S.write_bucketed(M.history(spark, folder), "history_" + path[-32:], path, buckets=8)


@query("c3_products_with_prior", "SELECT id, prior FROM products JOIN prior ON id = product_id")
def c3(spark, folder):
    _, products, history = tables(spark, folder)
    return products.select("id").join(L.prior_positions(history, **FLOORS), "id")


@query("c4_products_without_prior", "SELECT id, store_id FROM products WHERE id NOT IN (SELECT product_id FROM prior)")
def c4(spark, folder):
    _, products, history = tables(spark, folder)
    return products.select("id", "store_id").join(L.prior_positions(history, **FLOORS), "id", "left_anti")


@query("c7_d2_catalog_sizes", "SELECT * FROM sizes")
def d2(spark, folder):
    return L.catalog_sizes(M.products(spark, folder))


@query("e2_newest_event_per_label", "SELECT product_id, label, max(date) AS date FROM ledger GROUP BY ALL")
def e2(spark, folder):
    _, products, _, events = run_tables(spark, folder)
    found = [L.event_window(events, products, label=label, days=400, now=NOW, start=START).select("product_id", "label", "date") for label in ("hero", "villain")]
    return found[0].unionByName(found[1])


@query("e3_daily_last_snapshot", "SELECT product_id, CAST(date AS DATE) AS date, arg_max(position, (date, id)) AS position FROM history GROUP BY ALL")
def e3(spark, folder):
    return L.daily_last(M.history(spark, folder))


@query("e4_observed_steps", "SELECT product_id, date, position, lag(position) OVER (PARTITION BY product_id ORDER BY date) AS prior_position FROM (SELECT product_id, CAST(date AS DATE) AS date, arg_max(position, (date, id)) AS position FROM history GROUP BY ALL)")
def e4(spark, folder):
    return L.observed_steps(L.daily_last(M.history(spark, folder)))

from . import queries_catalog  # noqa: E402,F401
from . import queries_state  # noqa: E402,F401
from . import queries_search  # noqa: E402,F401
from . import queries_streaming  # noqa: E402,F401
