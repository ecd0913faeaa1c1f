"""Small inline cases of the operators, and plan checks."""

import datetime as dt

from pyspark.sql import functions as F

from trendmill.functions import text as X
from trendmill.operators import labels as L
from trendmill.operators import rules as R
from trendmill.operators import search as J
from trendmill.operators import state as S
from trendmill.sources import model as M
from trendmill.sources import pages as P

FLOORS = {"now": "2024-01-30 12:00:00", "epoch": "2024-01-08", "start": "2024-01-08"}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_thresholds(spark):
    sizes = spark.createDataFrame([(0,), (1,), (20,), (100,), (1000,)], "n int")
    assert [r[0] for r in sizes.orderBy("n").select(L.threshold(F.col("n"))).collect()] == [30, 1, 6, 30, 30]


def products(spark, rows):
    return spark.createDataFrame([(i, 1, at, True, "fashion") for i, at in rows], "id long, store_id long, current_position int, is_fashion boolean, subniche string")


def history(spark, rows):
    return spark.createDataFrame([(k, p, at, dt.datetime.fromisoformat(d)) for k, (p, at, d) in enumerate(rows)], "id long, product_id long, position int, date timestamp_ntz")


def labels(spark, own, past):
    filler = [(100 + k, 1000) for k in range(20)]
    found = L.movement_labels(products(spark, own + filler), history(spark, past), **FLOORS)
    return {r["id"]: (r["label"], r["position_change"], r["prior_position"]) for r in found.where("id < 100").collect()}


def test_labels_of_moves(spark):
    past = [(1, 5, "2024-01-29"), (2, 55, "2024-01-29"), (3, 5, "2024-01-30T01:00:00"), (4, 5, "2024-01-08"), (5, 5, "2024-01-07T23:59:59"), (6, 4, "2024-01-20"), (7, 2, "2024-01-20")]
    found = labels(spark, [(1, 2), (2, 5), (3, 2), (4, 2), (5, 2), (6, 4), (7, 5)], past)
    assert found == {1: ("hero", 3, 5), 2: ("normal", 0, 55), 3: ("new", 0, 0), 4: ("hero", 3, 5), 5: ("new", 0, 0), 6: ("normal", 0, 4), 7: ("villain", -3, 2)}


def test_newest_event_wins_and_both_labels_stay(spark):
    own = products(spark, [(1, 3)])
    ledger = spark.createDataFrame([(1, 1, dt.date(2024, 1, 25), "hero", 9, 5, 4), (1, 1, dt.date(2024, 1, 28), "hero", 5, 3, 2), (1, 1, dt.date(2024, 1, 26), "villain", 5, 6, -1)], "store_id long, product_id long, date date, label string, prior_position int, current_position int, position_change int")
    window = {"days": 7, "now": "2024-01-30", "start": "2024-01-08"}
    assert [str(r["date"]) for r in L.event_window(ledger, own, label="hero", **window).collect()] == ["2024-01-28"]
    assert L.event_window(ledger, own, label="villain", **window).count() == 1
    assert L.event_window(ledger, own, label="new", **window).count() == 0


def test_event_merge_is_idempotent(spark):
    ledger = spark.createDataFrame([(1, 1, dt.date(2024, 1, 30), "hero", 9, 5, 4)], "store_id long, product_id long, date date, label string, prior_position int, current_position int, position_change int")
    once = L.merge_events(ledger.where("false"), ledger)
    assert L.merge_events(once, ledger).collect() == once.collect() == ledger.collect()


def test_text_functions(spark):
    assert [one(spark, X.visitors(F.lit(v))) for v in ("24K", "1.9M", "12", "n/a", None)] == [24000, 1900000, 12, 0, 0]
    assert one(spark, X.store_url(F.lit("shop.example/collections/all?x#y"))) == "https://shop.example"
    assert one(spark, X.clean_tags(F.lit("img:type:a-b, img:a-b || Red, red"))) == "a b, red"
    assert one(spark, X.clean_title(F.lit("Neuheit"))) == ""
    assert one(spark, X.whole_word(F.lit("Lightweight Hiking Shoes"), "lighting")) is False
    assert one(spark, X.gender_contradiction(F.lit("for women"), F.lit("parfum homme"))) is True
    assert one(spark, X.scrape_warning(F.lit("Fashion & HD"), F.lit(3), F.lit(0))).startswith("General feed empty")


def item(spark, title, **more):
    row = {"title": title, "product_type": "", "handle": "", "product_url": "", "image_url": "", "subniche": "", "is_fashion": False} | more
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string'}" for k, v in row.items()))


def test_routing(spark):
    both = item(spark, "smartwatch ring", subniche="jewelry")
    assert R.route(both).select("is_fashion", "subniche").first() == (False, "electronics")
    assert R.route(item(spark, "HÄNGELAMPE")).select("is_fashion", "subniche").first() == (False, "home")
    assert R.route(item(spark, "Überraschungsbox", is_fashion=True)).first()["is_fashion"] is False
    assert R.route(item(spark, "thing", subniche="Exclude")).count() == 0
    watch = item(spark, "Smart Watch")
    assert watch.select(R.assign_category(watch)).first()[0] == "smartwatch"


def test_source_positions_keep_gaps(spark):
    rows = [("1", 1, s, h) for s, h in enumerate(["gift", "dress", "smartwatch", "sneakers"], 1)] + [("1", 2, 1, "dress"), ("1", 2, 2, "rod")]
    placed = R.source_positions(R.first_per_store(spark.createDataFrame(rows, "store_id string, page_id int, slot int, handle string")))
    assert {r["handle"]: r["source_position"] for r in placed.collect()} == {"gift": 1, "dress": 2, "smartwatch": 3, "sneakers": 4, "rod": 5}


def test_retirement_guard(spark):
    own = spark.createDataFrame([(k, 1, f"h{k}", True, "fashion") for k in range(8)], "id long, store_id long, handle string, is_fashion boolean, subniche string")
    for listed, left in ((4, 8), (5, 5)):
        seen = own.where(f"id < {listed}").select("store_id", "handle", "is_fashion")
        assert S.retire_absent(own, seen).where("is_fashion").count() == left


def test_scrape_application_is_idempotent(spark):
    p = M.products(spark, "/root/testdata/sf0.001")
    seen = p.where("id % 3 > 0").select("store_id", *S.OVERWRITTEN)
    once = S.apply_scrape(p, seen, now="2024-01-30 10:00:00").drop("listed")
    twice = S.apply_scrape(once, seen, now="2024-01-30 10:00:00").drop("listed")
    state = lambda df: sorted(map(tuple, df.select("id", "is_fashion", "subniche", "current_position").collect()))
    assert state(once) == state(twice)


def test_event_json_page(spark):
    html = r'<script>{"events":"[[\"collection_viewed\",{\"collection\":{\"productVariants\":[{\"price\":{\"amount\":5},\"image\":{\"src\":\"//c/x.jpg\"},\"product\":{\"id\":\"7\",\"title\":\"\",\"url\":\"/products/Red-Dress?v=1\",\"vendor\":\"V\",\"type\":\"T\"}}]}}]]"}</script>'
    pages = spark.createDataFrame([(1, "https://s.example/collections/a", html), (2, "https://s.example/b", None)], "page_id long, url string, html string")
    got = P.page_items(pages).collect()
    assert [(r["handle"], r["title"], r["price"], r["image_url"]) for r in got] == [("red-dress", "Red Dress", "5.00", "https://c/x.jpg")]


def test_conflict_takes_points(spark):
    row = {"title": "boots", "product_category": "", "subniche": "", "product_type": "", "handle": ""}
    asked = J.expand_queries(spark.createDataFrame([(1, "knee-high-boots")], "query_id long, text string"), vocabulary=()).withColumn("terms", F.array(F.lit("knee-high-boots")))
    scores = []
    for tags in ("img:type:ankle-boots", "img:type:other"):
        p = spark.createDataFrame([(1, *row.values(), tags)], "id long, title string, product_category string, subniche string, product_type string, handle string, ai_tags string")
        scores.append(J.score_products(p, asked).first()["kw"])
    assert scores[1] - scores[0] == 8


def test_plans_have_no_python_and_no_cartesian_product(spark):
    folder = "/root/testdata/sf0.001"
    from trendmill import queries, registry  # noqa: F401

    for name in ("h2_movement_labels", "h4_event_backfill", "i1_combined_fashion_feed", "g3_g8_scrape_application"):
        plan = registry.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "Pandas" not in plan


def test_json_page_of_a_megabyte_and_repeated_ids(spark):
    variant = r'{\"price\":{\"amount\":%d},\"image\":{\"src\":\"//c/%d.jpg\"},\"product\":{\"id\":\"%d\",\"title\":\"a \\\"%d\\\"\",\"url\":\"/products/p%d\"}}'
    many = ",".join(variant % ((k,) * 5) for k in range(1, 9001))
    html = '<script>{"events":"[[\\"collection_viewed\\",{\\"collection\\":{\\"productVariants\\":[' + many + ']}}]]"}</script>'
    assert len(html) > 1_000_000
    rows = [(1, "https://s.example/c", html)] + [(2, "https://s.example/d", '<a href="/products/x">a dress</a><a href="/products/y">b dress</a>')] * 3
    got = P.page_items(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got.where("page_id = 1").count() == 9000 and got.where("page_id = 1 AND slot = 7").first()["title"] == 'a "7"'
    assert got.where("page_id = 2").count() == 6


def test_cards_follow_the_shop_rules():
    own = lambda html: P._cards(html)[0]
    assert own('<body><a href="/products/out">no</a><main><a href="/products/in?x=1#y">in here</a></main></body>')[:2] == ("in", "in here")
    grid = '<main><ul>' + "".join(f'<li><a href="/products/p{k}"><img alt="pic {k}" srcset="//c/{k}.jpg 2x, //c/b.jpg"></a><span class="price--sale">-30%</span><span class="money">{k},50 €</span></li>' for k in (11, 12)) + "</ul></main>"
    assert P._cards(grid) == [(f"p{k}", f"pic {k}", f"{k},50", f"https://c/{k}.jpg") for k in (11, 12)]
    assert own('<div><section><a href="/products/red-shoe">Sale</a><p><img src="data:x"><img src="/i.png"></p><b class="amount">7</b><b class="amount">1234</b><i class="sale-price badge">99</i></section></div>') == ("red-shoe", "Red Shoe", "1234", "/i.png")
    deep = "<div>" * 300 + '<a href="/products/z">deep one</a>' + "</div>" * 300
    assert P._cards(f"<body>{deep}{deep.replace('/z', '/w')}</body>")[1][:2] == ("w", "deep one")
    wide = "<main><div>" + "".join(f'<a href="/products/n{k}">name {k}</a>' for k in range(3000)) + "</div></main>"
    assert len(P._cards(wide)) == 3000


def test_tables_of_a_user_reach_every_rule(spark):
    tables = R.Tables(junk={"title": r"\bsample\b", "product_type": r"\bx\b", "url": "zzz"}, general=r"\bdrill\b", fashion=r"\bcape\b", subniches=(("tools", r"\bdrill\b"),), catalog=(("cape", "coats", r"\bcapes?\b"),))
    rows = [(1, "sample cape"), (2, "drill"), (3, "red cape"), (4, "ring")]
    own = spark.createDataFrame([(k, 1, t, f"h{k}", "", "", "", "", "", "", k == 2, "bags" if k == 2 else "other", 5) for k, t in rows], "id long, store_id long, title string, handle string, product_type string, product_url string, image_url string, ai_tags string, price string, vendor string, is_fashion boolean, subniche string, current_position int")
    routed = {r["id"]: (r["is_fashion"], r["subniche"]) for r in R.route(own, tables).collect()}
    assert routed == {2: (False, "tools"), 3: (True, "fashion"), 4: (False, "other")}
    swept = S.maintain(own.withColumn("product_category", F.lit("")), tables)
    assert {r["id"]: (r["is_fashion"], r["subniche"], r["product_category"]) for r in swept.collect()} == {1: (True, "fashion", "cape"), 2: (False, "tools", ""), 3: (True, "fashion", "cape"), 4: (False, "other", "")}
    words = J.Dictionaries(translations=(("cape", "umhang"),), synonyms=(), nouns=(("coat", "cape"),), aliases=(("capes", "coat"),))
    titles = own.withColumn("product_category", F.lit("")).withColumn("title", F.when(F.col("id") == 4, "roter Umhang").otherwise(F.col("title")))
    hits = lambda cond: sorted(r["id"] for r in titles.where(cond).collect())
    assert hits(J.word_condition(titles, "capes", words)) == [1, 3, 4] and hits(J.loose_match(titles, "drill", words)) == [2]


def test_scrape_plan_joins_the_state_once(spark):
    p = M.saved(M.products(spark, "/root/testdata/sf0.001"))
    state = S.apply_scrape(p, p.where("id % 3 > 0").select("store_id", *S.OVERWRITTEN), now="2024-01-30 10:00:00")
    assert state._jdf.queryExecution().analyzed().toString().count("Join FullOuter") == 1


def test_a_run_appends_snapshots_and_events(spark, tmp_path):
    p = products(spark, [(1, 9)]).withColumns({c: F.lit("x") for c in ("title", "handle", "image_url", "price", "vendor", "product_type", "ai_tags", "product_category", "last_scraped")}).withColumn("last_scraped", F.lit("2024-01-01").cast("timestamp_ntz"))
    past = history(spark, [(1, 9, "2024-01-29")])
    ledger = spark.createDataFrame([], "store_id long, product_id long, date date, label string, prior_position int, current_position int, position_change int")
    seen = p.withColumn("current_position", F.lit(8)).select("store_id", *S.OVERWRITTEN)
    state, snapshots, events = S.apply_run(p, past, ledger, seen, **FLOORS)
    assert state.first()["current_position"] == 8 and snapshots.first()["position"] == 8
    assert [(r["label"], r["position_change"]) for r in events.collect()] == [("hero", 1)]
    for _ in range(2):  # a repeated run has the same effect
        S.write_history(snapshots, str(tmp_path / "history"), "r1")
    assert S.read_history(spark, str(tmp_path / "history")).count() == 1
    assert S.newest_state(spark, str(tmp_path / "none")) is None


def test_failed_batches_are_told(spark):
    from trendmill.operators import enrich as K

    def score(rows):
        if rows[0]["id"] == 0:
            raise ValueError
        return [{"tags": "t"}]

    got = K.batched_scores(spark.range(4).coalesce(1).withColumn("title", F.lit("x")), score, ("title",), "tags string", size=2)
    assert sorted(map(tuple, got.collect())) == [(0, None, True), (1, None, True), (2, "t", False), (3, None, False)]
