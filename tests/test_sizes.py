"""How steps grow: files, tasks and memory that must not follow the number of keys or the splits of a small file."""

import re

from pyspark.sql import functions as F

from trendmill import queries_streaming as QS
from trendmill.operators import search as J
from trendmill.operators import state as S
from trendmill.registry import QUERIES
from trendmill.sources import model as M
from trendmill.sources import pages as P
from trendmill.streaming import increments as N

FOLDER = "/root/testdata/sf0.001"


def test_versioned_state_has_no_folder_per_store(spark, tmp_path):
    assert not [f for f in QUERIES["a12_versioned_state"](spark, "/root/testdata/sf0.01").inputFiles() if "store_id=" in f]
    rows = spark.range(3000).select("id", (F.col("id") % 500).alias("store_id"))
    S.write_state(rows, str(tmp_path), 1, order_by=("store_id", "id"))
    got = S.newest_state(spark, str(tmp_path))
    assert len(got.inputFiles()) <= 4 and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


def test_derived_pages_are_dealt_to_all_tasks(spark):
    for make in (QS.card_pages, QS.json_pages):
        assert make(spark, FOLDER).rdd.getNumPartitions() == 4


def test_pages_are_parsed_once(spark):
    events = '<script>{"events":"[[\\"collection_viewed\\",{\\"collection\\":{\\"productVariants\\":[{\\"product\\":{\\"id\\":\\"1\\",\\"url\\":\\"/products/a\\"}}]}}]]"}</script>'
    rows = [(1, "https://s.example/collections/all", events), (2, "https://s.example/collections/all", '<main><a href="/products/b">Bee</a></main>'), (3, None, None), (4, "https://s.example/x", '"events":"no" <a href="/products/c">Cee</a>')]
    got = P.page_items(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert "from_json" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["page_id"], r["handle"]) for r in got.collect()) == [(1, "a"), (2, "b"), (4, "c")]


def searched(spark):
    p = spark.createDataFrame([(k, f"red ring {k}", f"h{k}", "", "ring", "jewelry", k + 1) for k in range(30)], "id long, title string, handle string, ai_tags string, product_category string, subniche string, current_position int").withColumn("product_type", F.lit(""))
    queries = J.expand_queries(spark.createDataFrame([(k, "Hot ring") for k in range(40)], "query_id long, text string"))
    units = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(3)], "id long, unit array<double>")
    return p, units, queries, units.where("id = 1").select(F.col("id").alias("query_id"), "unit")


def test_equal_queries_are_searched_and_scored_once(spark, monkeypatch):
    asked, search = [], J.named_by_terms
    monkeypatch.setattr(J, "named_by_terms", lambda p, q, k: (asked.append(q.count()), search(p, q, k))[1])
    args = searched(spark)
    got = J.hybrid_search(*args, top_k=2, limit=3).orderBy("query_id", "rank").collect()
    assert asked == [1]
    alone = [[tuple(r)[1:] for r in got if r["query_id"] == k] for k in range(40) if k != 1]
    assert all(own == alone[0] for own in alone) and [i for i, _, _ in alone[0]] == [0, 1]
    assert [r["id"] for r in got if r["query_id"] == 1] == [2, 1, 0]
    told = {r["query_id"]: (r["candidates"], r["by_vector"], r["best"]) for r in J.explain_search(*args, top_k=2).collect()}
    assert told[0] == (2, 0, [0, 1]) and told[1] == (3, 2, [2, 1, 0]) and len(told) == 40


def test_judged_batches_may_span_arrow_batches(spark):
    ranked = spark.createDataFrame([(q, r, 1.0, r) for q in range(5) for r in range(1, 11)], "query_id long, id long, score double, rank int")
    p = spark.range(1, 11).select("id", F.lit("t").alias("title"), F.lit(None).cast("string").alias("ai_tags"))

    def judge(rows):
        assert [r["rank"] for r in rows] == list(range(rows[0]["rank"], rows[0]["rank"] + len(rows))) and len(rows) in (4, 2)
        if rows[0]["rank"] == 5:
            raise ValueError
        return [{"match": r["id"] % 2 == 0} for r in rows]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = J.judged_search(ranked, p, judge, page=10, batch=4, limit=20)
        assert "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString()  # no Python call's frames per batch
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [[r["id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q] for q in range(5)] == [[2, 4, 5, 6, 7, 8, 10]] * 5


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_products_and_their_progress_are_never_broadcast(spark):
    assert not re.search(r"BroadcastHashJoin \[p_partkey", planned(M.history(spark, FOLDER)))
    products, progress = M.saved(QS.first_products(spark, FOLDER)), M.saved(spark.createDataFrame([], N.PROGRESS))
    now = QS.RUNS[2]
    scraped = M.saved(QS.run_scrapes(spark, FOLDER)).where(F.date_format("date", "yyyy-MM-dd HH:mm:ss") == now).drop("date")
    _, snapshots, events, _ = N.apply_increment(products, progress, scraped, now=now, rules=N.Rules(M.START, M.START))
    for df in (snapshots, events):
        assert "SortMergeJoin [store_id" in planned(df) and not re.search(r"BroadcastHashJoin \[(store_id#\d+L, _key|id)#", planned(df))


def test_scores_of_a_block_are_made_in_slices():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from trendmill.operators import vectors as V

    rows = np.random.default_rng(7).normal(size=(8192, 16))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    blocks = V._packed(pa.table({"block": pa.array([0] * 8192, pa.int32()), "cell": pa.array([0] * 8192, pa.int32()), "id": np.arange(8192), "unit": pa.array(list(rows))}))
    asked = pa.table({"query_id": np.arange(2048), "q": pa.array(list(rows[:2048]))})
    tracemalloc.start()
    found = V._search(5)(blocks, asked).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # all scores of the block are 134 MB
    assert found["pairs"].iloc[-1] == 2048 and found["query_id"].isna().sum() == 1 and len(found) == 5 * 2048 + 1
    for q in range(0, 2048, 97):
        own = np.round(rows @ rows[q], 12)
        assert found[found["query_id"] == q]["id"].tolist() == np.lexsort((np.arange(8192), -own))[:5].tolist()


def test_newest_events_read_a_stored_ledger(spark):
    plan = planned(QUERIES["e2_newest_event_per_label"](spark, FOLDER))
    assert "Window" not in plan and len(re.findall("SortMergeJoin", plan)) == 2  # one for each label, in tasks of their own
