"""Runs of scrapes: doubled handles, appended snapshots, joint commits, incremental runs, days that close."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trendmill.operators import commits as C
from trendmill.operators import labels as L
from trendmill.operators import state as S
from trendmill.streaming import increments as N
from trendmill.streaming import ingest as I

PRODUCT = "id long, store_id long, handle string, title string, product_type string, vendor string, price string, image_url string, ai_tags string, current_position int, is_fashion boolean, subniche string, product_category string, last_scraped timestamp_ntz, vision_classified_at timestamp_ntz"
SCRAPED = "store_id long, handle string, title string, image_url string, price string, vendor string, product_type string, ai_tags string, current_position int, is_fashion boolean, subniche string"
FLOORS = {"epoch": "2024-01-02", "start": "2024-01-02"}


def products(spark, rows):
    return spark.createDataFrame([(i, store, handle, title, "", "", "", "", "", at, True, "fashion", "", None, None) for i, store, handle, title, at in rows], PRODUCT)


def scrape(spark, rows, fashion=True):
    return spark.createDataFrame([(store, handle, title, "", "1", "", "", "", at, fashion, "fashion" if fashion else "home") for store, handle, title, at in rows], SCRAPED)


def test_a_handle_listed_twice_is_one_row_and_the_last_wins(spark):
    own = products(spark, [(1, 1, "a", "old a", 3)])
    seen = scrape(spark, [(1, "a", "first", 2), (1, "a", "later", 9), (1, "new", "one", 4), (1, "new", "two", 5), (2, "a", "other store", 1)])
    both = seen.unionByName(scrape(spark, [(1, "new", "general", 1)], fashion=False))
    got = {(r["store_id"], r["handle"]): r for r in S.upsert_products(own, both, now="2024-01-05").collect()}
    assert len(got) == 3 and got[1, "a"]["id"] == 1 and (got[1, "a"]["title"], got[1, "a"]["current_position"]) == ("later", 9)
    assert (got[1, "new"]["title"], got[1, "new"]["is_fashion"]) == ("general", False) and not got[1, "new"]["existed"]
    twice = S.upsert_products(own, both.unionByName(both), now="2024-01-05")
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, got.values()))


def test_vision_time_follows_the_scrape(spark):
    own = products(spark, [(1, 1, "a", "x", 3), (2, 1, "b", "x", 4)])
    seen = scrape(spark, [(1, "a", "x", 1), (1, "b", "x", 2)]).withColumn("vision_classified", F.col("handle") == "a")
    got = {r["handle"]: r["vision_classified_at"] for r in S.upsert_products(own, seen, now="2024-01-05 06:00:00").collect()}
    assert got == {"a": dt.datetime(2024, 1, 5, 6), "b": None}


def snapshots(spark, rows):
    return spark.createDataFrame([(p, s, at, dt.datetime.fromisoformat(d)) for p, s, at, d in rows], "product_id long, store_id long, position int, date timestamp_ntz")


def test_two_runs_of_a_day_both_stay_and_a_repeated_one_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "history")
    S.write_history(snapshots(spark, [(1, 1, 5, "2024-01-05T06:00:00"), (9, 1, 6, "2024-01-04T23:00:00")]), path, "morning")
    for _ in range(2):
        S.write_history(snapshots(spark, [(2, 2, 7, "2024-01-05T18:00:00")]), path, "evening")
    rows = S.read_history(spark, path)
    assert sorted((r["product_id"], r["run"], str(r["day"])) for r in rows.collect()) == [(1, "morning", "2024-01-05"), (2, "evening", "2024-01-05"), (9, "morning", "2024-01-04")]
    S.write_history(snapshots(spark, [(1, 1, 4, "2024-01-05T06:00:00")]), path, "morning")  # the run is replaced as a whole
    assert sorted((r["product_id"], r["position"]) for r in S.read_history(spark, path).collect()) == [(1, 4), (2, 7)]


def test_retention_reads_no_older_day(spark, tmp_path):
    path = str(tmp_path / "history")
    S.write_history(snapshots(spark, [(k, 1, 5, f"2024-01-{k:02}T12:00:00") for k in range(1, 21)]), path, "r")
    kept = L.keep_recent(S.read_history(spark, path), now="2024-01-20 12:00:00", days=3)
    assert sorted(r["product_id"] for r in kept.collect()) == [17, 18, 19, 20]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "day" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_readers_see_all_tables_of_a_commit_or_none(spark, tmp_path):
    path = str(tmp_path / "tables")
    assert C.newest_commit(spark, path) is None
    old, new = spark.range(2), spark.range(3)
    C.write_part(old, path, "products", "a")
    C.write_part(old, path, "history", "a")
    first = C.Commit(1, {"products": ["a"], "history": ["a"]})
    C.write_commit(spark, path, first)
    C.write_part(new, path, "products", "b")  # a run that ends here is never seen
    seen = C.newest_commit(spark, path)
    assert seen == first and C.committed(spark, path, seen, "products").count() == 2 and C.committed(spark, path, seen, "ledger") is None
    C.write_part(new, path, "history", "b")
    second = first.with_parts(2, {"history": "b"}, {"products": "b"})
    C.write_commit(spark, path, second)
    assert C.newest_commit(spark, path) == second and C.newest_commit(spark, path, before=2) == first
    assert C.committed(spark, path, second, "products").count() == 3 and C.committed(spark, path, second, "history").count() == 5
    assert C.committed(spark, path, first, "products").count() == 2  # readers of the older commit aren't disturbed


LISTS = [  # run, listed (store, handle, position)
    ("2024-01-03 06:00:00", [(1, f"h{k}", k) for k in range(1, 9)]),
    ("2024-01-03 18:00:00", [(2, f"g{k}", k) for k in range(1, 7)]),
    ("2024-01-04 06:00:00", [(1, f"h{k}", 9 - k) for k in range(1, 7)] + [(1, "h1", 3), (1, "fresh", 12)]),
    ("2024-01-04 18:00:00", [(1, f"h{k}", k) for k in range(1, 5)] + [(2, "g1", 2), (2, "g2", 1)]),
    ("2024-01-06 06:00:00", [(1, f"h{k}", k + 1) for k in range(1, 9)] + [(2, f"g{k}", 7 - k) for k in range(1, 7)]),
    ("2024-01-06 18:00:00", [(1, f"h{k}", k) for k in range(1, 9)]),
]


def test_incremental_runs_equal_runs_over_the_whole_history(spark, tmp_path):
    rules = N.Rules(**FLOORS)
    first = products(spark, [(k, 1, f"h{k}", "thing", k) for k in range(1, 13)] + [(20 + k, 2, f"g{k}", "thing", k) for k in range(1, 7)])
    stream, state = str(tmp_path / "in"), first
    path = str(tmp_path / "tables")
    N.begin(spark, path, first)
    history = spark.createDataFrame([], "id long, product_id long, store_id long, position int, date timestamp_ntz")
    ledger = spark.createDataFrame([], "store_id long, product_id long, date date, label string, prior_position int, current_position int, position_change int")
    schema = None
    for batch in (LISTS[:3], LISTS[3:4], LISTS[4:]):
        for k, (now, listed) in enumerate(batch):
            seen = scrape(spark, [(s, h, "thing", at) for s, h, at in listed])
            rows = seen.withColumn("date", F.lit(now).cast("timestamp"))
            rows.coalesce(1).write.mode("append").parquet(stream)
            schema = rows.schema
            stores = sorted({s for s, _, _ in listed})
            own = state.where(F.col("store_id").isin(*stores))
            after, new, ledger = S.apply_run(own, history, ledger, seen, now=now, **FLOORS)
            pinned = lambda df: spark.createDataFrame(df.collect(), df.schema)
            state = pinned(state.where(~F.col("store_id").isin(*stores)).unionByName(after.drop("listed")))
            ledger = pinned(ledger)
            history = pinned(history.unionByName(new.withColumn("id", F.monotonically_increasing_id() + 1000 * (history.count() + 1)).select(*history.columns)))
        I.ingest(spark.readStream.schema(schema).parquet(stream), N.apply_batches(path, rules), str(tmp_path / "checkpoint"))
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    assert rows(N.table_of(spark, path, "products"), "id", "handle", "current_position", "is_fashion", "subniche") == rows(state, "id", "handle", "current_position", "is_fashion", "subniche")
    assert rows(N.table_of(spark, path, "history"), "product_id", "position", "date") == rows(history, "product_id", "position", "date")
    assert rows(N.table_of(spark, path, "ledger"), *N.EVENTS) == rows(ledger, *N.EVENTS)
    assert ledger.count() > 10 and state.where("NOT is_fashion").count() > 0
    by_history = N.progress_of(history, **FLOORS)
    assert rows(N.table_of(spark, path, "progress"), "product_id", "day", "position", "before") == rows(by_history, "product_id", "day", "position", "before")
    # a batch that is repeated, as after a failure, changes nothing
    before = rows(N.table_of(spark, path, "ledger"), *N.EVENTS)
    last = spark.read.schema(schema).parquet(stream).where("date >= '2024-01-06'")
    version = C.newest_commit(spark, path).version
    N.apply_batches(path, rules)(last, version)
    assert rows(N.table_of(spark, path, "ledger"), *N.EVENTS) == before and N.table_of(spark, path, "history").count() == history.count()


def test_a_run_reads_no_history(spark):
    own, seen = products(spark, [(1, 1, "a", "x", 3)]), scrape(spark, [(1, "a", "x", 2)])
    progress = spark.createDataFrame([(1, dt.date(2024, 1, 3), dt.datetime(2024, 1, 3, 6), 3, None)], N.PROGRESS)
    _, _, events, further = N.apply_increment(own, progress, seen, now="2024-01-04 06:00:00", rules=N.Rules(**FLOORS))
    assert [(r["label"], r["prior_position"]) for r in events.collect()] == [("hero", 3)] and further.first()["before"] == 3
    _, late, none, same = N.apply_increment(own, progress, seen, now="2024-01-02 06:00:00", rules=N.Rules(**FLOORS))
    assert none.count() == 0 and late.count() == 1 and same.first()["position"] == 3  # a run of an earlier day


def test_a_scrape_joins_the_state_once_and_counts_by_broadcast(spark):
    own, seen = products(spark, [(1, 1, "a", "x", 3)]), scrape(spark, [(1, "a", "x", 2)])
    plan = S.apply_scrape(own, seen, now="2024-01-04 06:00:00")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join FullOuter") == 1 and plan.count("Join LeftOuter") == 1 and plan.count("Join ") == 2 and "broadcast" in plan


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(I.STATE_STORE[0])
    spark.conf.set(*I.STATE_STORE)
    yield
    spark.conf.set(I.STATE_STORE[0], before)


def test_days_close_by_time_and_late_snapshots_are_dropped(spark, tmp_path, rocks):
    own = products(spark, [(k, 1, f"h{k}", "x", k) for k in range(1, 41)]).select("id", "store_id", "is_fashion", "subniche")  # threshold 12
    steps = [
        [(1, 5, "2024-01-03T06:00:00"), (1, 4, "2024-01-03T18:00:00"), (2, 9, "2024-01-03T09:00:00"), (3, 1, "2024-01-03T09:00:00")],
        [(1, 8, "2024-01-05T06:00:00"), (1, 2, "2024-01-05T04:00:00"), (2, 30, "2024-01-05T06:00:00"), (99, 1, "2024-01-05T06:00:00")],
        [(1, 1, "2024-01-03T20:00:00"), (2, 20, "2024-01-06T23:00:00"), (3, 3, "2024-01-07T12:00:00")],
    ]

    def run():
        stream = I.movement_stream(spark.readStream.schema(I.SNAPSHOT).parquet(str(tmp_path / "in")), own, start="2024-01-02")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["product_id"], str(r["date"]), r["label"], r["prior_position"], r["current_position"]) for r in spark.read.schema(I.MOVEMENT).parquet(str(tmp_path / "out")).collect())

    found = []
    for rows in steps:
        own_rows = [(k, p, 1, at, dt.datetime.fromisoformat(d)) for k, (p, at, d) in enumerate(rows)]
        spark.createDataFrame(own_rows, I.SNAPSHOT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found.append(run())
    assert found[0] == [] and found[1] == []  # the day of the newest snapshot is open
    assert found[2] == [(1, "2024-01-05", "villain", 4, 8), (2, "2024-01-06", "hero", 30, 20)]  # 9 to 30 is beyond the threshold; the late one is dropped


def test_closed_days_of_many_products_are_compared_in_one_call():
    import pandas as pd

    class State:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    own = I.DailyMovements(keep=3)
    own.closed = State()

    def call(*rows):
        frame = pd.DataFrame([(p, d, at, 1, 12, dt.date(1970, 1, 1) + dt.timedelta(d)) for p, d, at in rows], columns=["product_id", "day", "position", "store_id", "threshold", "date"])
        found = pd.concat(own.handleInputRows((0,), iter([frame[:1], frame[1:]]), None))
        return sorted(zip(found["product_id"], found["date"].map(lambda x: (x - dt.date(1970, 1, 1)).days), found["label"], found["prior_position"], strict=True))

    assert call((2, 11, 7), (1, 10, 5), (2, 10, 9), (3, 10, 4)) == [(2, 11, "hero", 9)]
    assert call((1, 13, 6), (2, 12, 40)) == [(1, 13, "villain", 5)]  # 7 to 40 is beyond the threshold
    assert 3 in own.closed.held[0]
    assert call((1, 14, 5), (3, 14, 1)) == [(1, 14, "hero", 6)]  # product 3 was away too long
