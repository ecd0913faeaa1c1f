"""Aliases, postings, tables of a user, phrase catalogs, codecs, pages, bucketed tables."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendmill.functions import text as X
from trendmill.operators import enrich as K
from trendmill.operators import labels as L
from trendmill.operators import rules as R
from trendmill.operators import search as J
from trendmill.operators import state as S
from trendmill.operators import vectors as V
from trendmill.sources import model as M
from trendmill.sources import pages as P

FOLDER = "/root/testdata/sf0.001"
NOUNS = (("bag", "tote"), ("bag", "pouch"), ("lighting", "lamp"), ("dress", "robe"))
ALIASES = (("handbags", "handbag"), ("handbag", "satchel"), ("satchel", "bag"), ("a", "b"), ("b", "c"), ("c", "a"), ("lights", "lighting"), ("light", "nowhere"), ("dress", "bag"))


@pytest.mark.parametrize("word,canonical", [("handbags", "bag"), ("Handbag", "bag"), ("satchels", "bag"), ("bags", "bag"), ("bag", "bag"), ("lights", "lighting"), ("lightings", "lighting"), ("light", None), ("a", None), ("b", None), ("blue", None), ("dress", "dress"), ("dresses", "dress"), ("handbagses", "bag"), ("bagss", None)])
def test_alias_chains_singulars_and_loops(spark, word, canonical):
    got = {(r["canonical"], r["noun"]) for r in J.resolve_aliases(spark.createDataFrame([(word,), (word,), (None,)], "word string"), ALIASES, NOUNS).collect()}
    assert got == {(c, n) for c, n in NOUNS if c == canonical}
    assert J.Dictionaries(aliases=ALIASES, nouns=NOUNS).canonical(word) == [canonical] * (canonical is not None)


def test_closure_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(300)], "token string, canonical string")
    ends = J.alias_closure(links, spark.createDataFrame([("w300", "noun")], "canonical string, noun string"))
    assert {r["canonical"] for r in ends.collect()} == {"w300"} and ends.count() == 301
    assert J.alias_closure(links.where("false"), spark.createDataFrame([("x", "y")], "canonical string, noun string")).collect() == [("x", "x")]


def test_category_words_never_match_loosely_in_names(spark):
    own = spark.createDataFrame([(1, "Lampoon light", "", "", "", "", ""), (2, "Desk lamp", "", "", "", "", ""), (3, "Blueish", "", "", "", "", "")], "id long, title string, handle string, product_type string, ai_tags string, subniche string, product_category string")
    words = J.Dictionaries((), (), NOUNS, ALIASES)
    found = lambda text: sorted(r["id"] for r in own.where(J.loose_match(own, text, words)).collect())
    assert found("lighting") == [2] and found("lighting blue") == [2, 3]
    border = lambda text, term: own.limit(1).select(X.loose_word(F.lit(text), term, "border").alias("x")).first()["x"]
    assert border("a Handbag", "bag") and not border("baggy", "bag") and border("x.y+", "y+")


def brute_terms(rows, terms):
    return sorted((i, t) for i, text in rows for t in set(terms) if t and t in (text or "").lower())


def test_postings_equal_a_scan(spark):
    draw = random.Random(4)
    rows = [(k, "".join(draw.choice("abAé ") for _ in range(draw.randrange(30))) if k % 9 else None) for k in range(300)]
    terms = ["".join(draw.choice("abé ") for _ in range(draw.randrange(1, 6))) for _ in range(80)] + ["zzz", "a", "é ", "", None]
    df = spark.createDataFrame(rows, "id long, title string")
    got = J.rows_with_terms(df, spark.createDataFrame([(t,) for t in terms], "term string"), F.col("title"))
    assert sorted(map(tuple, got.collect())) == brute_terms(rows, [t for t in terms if t])
    assert J.rows_with_terms(df, spark.createDataFrame([], "term string"), F.col("title")).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_best_scores_equal_all_pairs(spark):
    p = M.saved(M.products(spark, FOLDER))
    texts = ["red ring", "knee-high-boots", "blue", "zz", "for women", "img:type", "a", "ring rod plate dish large-red"]
    asked = M.saved(J.expand_queries(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string"), denied=("ring",)))
    conflicts = (("ring", "rod"), ("blue", "plate"))
    every = J.score_products(p, asked, conflicts).where("kw > 0").collect()
    want = {(r["query_id"], r["id"], r["kw"]) for r in every}
    got = J.best_scores(p, asked, 10**6, conflicts)
    assert {(r["query_id"], r["id"], r["kw"]) for r in got.collect()} == want and len(want) > 50
    other = {(r["query_id"], r["id"], r["kw"]) for r in J.best_scores(p, asked, 10**6, ()).collect()}
    assert other != want
    assert "ring" not in asked.where("query_id = 0").first()["strong"]


def test_a_users_tables_reach_the_modes_without_model(spark):
    rows = spark.createDataFrame([(1, "sample cape", "", "", "", "", False, "home"), (2, "gift card", "", "", "", "", False, "home")], "id long, title string, product_type string, handle string, product_url string, image_url string, is_fashion boolean, subniche string")
    tables = R.Tables(junk={"title": r"\bsample\b", "product_type": r"\bx\b", "url": "zzz"})
    assert [r["id"] for r in K.without_model(rows, tables).collect()] == [2] and [r["id"] for r in K.without_model(rows).collect()] == [1]
    flagged = spark.createDataFrame([(1, True), (2, True)], "id long, wearable boolean")
    assert [r["id"] for r in K.reclassify_general(rows, flagged, False, tables).collect()] == [2]


def titled(spark, titles):
    return spark.createDataFrame([(k, t, "", "", "") for k, t in enumerate(titles)], "id long, title string, handle string, image_url string, product_type string")


def test_phrase_catalogs_take_the_first_in_order(spark):
    catalog = (("b", "x", ("blue shoe", "shoes")), ("a", "x", ("shoe", "é clair")), ("c", "x", ("blue",)))
    own = titled(spark, ["Blue  SHOE!", "a shoe, blue", "blueshoe", "É-Clair", "horse-shoes", None, "blue"])
    got = {r["id"]: r["c"] for r in own.select("id", R.phrase_categories(own, catalog).alias("c")).collect()}
    assert got == {0: "b", 1: "a", 2: "", 3: "a", 4: "b", 5: "", 6: "c"}


def test_phrase_catalogs_do_not_slow_down_with_size(spark):
    draw = random.Random(2)
    words = [f"{a}{b}" for a in "bcdfghjk" for b in ("ale", "ork", "ing", "ust", "and", "orn")]
    own = M.saved(titled(spark, [" ".join(draw.choice(words) for _ in range(12)) for _ in range(20000)]).repartition(4))
    took = {}
    for size in (10, 1000, 10, 1000):  # the second time counts
        catalog = tuple((f"c{k}", "p", (f"{words[k % 48]} nothing{k}", f"rare{k}")) for k in range(size))
        begin = time.time()
        own.select(R.phrase_categories(own, catalog).alias("c")).groupBy("c").count().collect()
        took[size] = time.time() - begin
    assert took[1000] < 2 * took[10] + 1


def test_vectors_survive_both_codecs(spark):
    rows = [(1, [1.5, -2.0]), (2, None), (3, []), (4, [0.25]), (5, [1.0] * 100)]
    own = spark.createDataFrame(rows, "id long, v array<float>").coalesce(1)
    back = own.select("id", V.parse_vector(V.encode_vector(F.col("v"))).alias("b"), V.parse_vector(F.to_json("v")).alias("j"))
    assert {r["id"]: (r["b"], r["j"]) for r in back.collect()} == {1: ([1.5, -2.0],) * 2, 2: (None, None), 3: (None, None), 4: ([0.25],) * 2, 5: ([1.0] * 100,) * 2}
    bad = spark.createDataFrame([("b64:!!",), ("b64:AAA=",), ("[1, x",), ("",), ("{}",), (None,), ("b64:AACAPw==",)], "s string")
    assert [r["v"] for r in bad.coalesce(1).select(V.parse_vector(F.col("s")).alias("v")).collect()] == [None] * 6 + [[1.0]]


def test_links_need_a_border_and_the_main_region(spark):
    html = '<a href="/products/out">x</a><main class="m"><a class="c" href="https://s.example/collections/all/products/Red-1?v=2">x</a><a href="products/two">x</a><a href="/myproducts/no">x</a><a href="/products/-bad">x</a><a href="/products/three#r">x</a></main>'
    pages = spark.createDataFrame([(1, "https://s.example/c", html), (2, "https://s.example/d", '<a href="/products/out">x</a>'), (3, None, None)], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["slot"], r["handle"]) for r in P.link_items(pages).collect()) == [(1, 1, "red-1"), (1, 2, "two"), (1, 3, "three"), (2, 1, "out")]
    assert [c[0] for c in P._cards('<main><a href="/myproducts/no">no one</a><a href="/products/yes/">yes one</a></main>')] == ["yes"]


def test_pages_of_one_id_stand_alone(spark):
    own = lambda i, h: r'{\"price\":{\"amount\":5},\"image\":{\"src\":\"/x.jpg\"},\"product\":{\"id\":\"%s\",\"title\":\"t%s\",\"url\":\"/products/%s\"}}' % (i, h, h)
    page = lambda *v: '<script>{"events":"[[\\"collection_viewed\\",{\\"collection\\":{\\"productVariants\\":[' + ",".join(v) + ']}}]]"}</script>'
    cards = '<script>{"events":"[]"}</script><main><a href="/products/card">a card here</a></main>'
    rows = [(1, "https://s.example/c", page(own(7, "a"), own(8, "b"), own(7, "c"), own(9, ""))), (1, "https://s.example/c", page(own(7, "a"))), (1, "https://s.example/c", cards), (1, None, None)]
    got = P.page_items(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted((r["slot"], r["handle"]) for r in got.collect()) == [(1, "a"), (1, "a"), (1, "card"), (2, "b")]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_bucketed_history_is_not_shuffled(spark):
    from trendmill.queries import FLOORS, bucketed_history

    stored = bucketed_history(spark, FOLDER)
    for plan in (L.prior_positions(stored, **FLOORS), L.observed_steps(L.daily_last(stored)), L.daily_last(stored).join(L.prior_positions(stored, **FLOORS).withColumnRenamed("id", "product_id"), "product_id").hint("merge")):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    products = M.saved(M.products(spark, FOLDER))
    labelled = L.movement_labels(products, stored, **FLOORS)
    assert sorted(map(tuple, labelled.select("id", "label").collect())) == sorted(map(tuple, L.movement_labels(products, M.history(spark, FOLDER), **FLOORS).select("id", "label").collect()))
    spark.sql(f"DROP TABLE {stored.inputFiles()[0].split('/')[-2].replace('state-', 'history_')}")
    assert S.write_bucketed(products.limit(0), "none_of_them", M.new_folder(spark), key="id", buckets=2).count() == 0


def test_blocked_search_equals_a_scan_and_skips_blocks(spark):
    random_ = np.random.default_rng(3)
    centres = random_.normal(size=(12, 16))
    rows = np.concatenate([c + 0.05 * random_.normal(size=(120, 16)) for c in centres] + [np.tile(centres[:1], (300, 1))])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    ids = random_.permutation(len(rows))
    index = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, rows)] + [(9999, None)], "id long, unit array<double>")
    asked = [(1, rows[0].tolist()), (2, rows[-1].tolist()), (3, (-rows[5]).tolist()), (4, [0.0] * 16), (5, random_.normal(size=16).tolist())]
    queries = spark.createDataFrame(asked, "query_id long, unit array<double>")
    want = set()
    for query_id, q in asked:
        score = np.round(rows @ np.array(q), 12)
        order = np.lexsort((ids, -score))[:25]
        want |= {(query_id, int(ids[o]), n) for n, o in enumerate(order, 1) if any(q)}
    got = V.vector_top_k(index, queries, 25)
    assert {(r["query_id"], r["id"], r["rank"]) for r in got.collect()} == want
    assert not any(w in got._jdf.queryExecution().executedPlan().toString() for w in ("NestedLoop", "Cartesian", "BroadcastExchange"))
    blocks = M.saved(V.packed_blocks(index.where("unit IS NOT NULL"), values=16 * 40))
    told = V.searched_blocks(blocks, queries, 25).where("query_id IS NULL").agg(F.sum("pairs"), F.sum("skipped")).first()
    assert blocks.agg(F.sum(F.size("ids"))).first()[0] == len(rows) and told[0] == 4 * blocks.count() and told[1] > 0.3 * told[0]
    assert V.vector_top_k(index.where("false"), queries, 5).count() == 0 and V.vector_top_k(index, queries.where("false"), 5).count() == 0


def alike(spark, n):
    """Products of two looks, numbered handles."""
    return M.saved(spark.range(n).selectExpr("id", "if(id % 2 = 0, 'red ring', 'blue plate') AS title", "cast(NULL AS STRING) AS ai_tags", "'' AS product_category", "'' AS subniche", "'' AS product_type", "concat('h-', id) AS handle"))


def test_products_and_queries_that_are_alike_are_scored_once(spark):
    p = alike(spark, 3000)
    asked = M.saved(J.expand_queries(spark.range(40).selectExpr("id AS query_id", "if(id < 39, 'a red ring', 'h 1234') AS text")))
    kinds = J.in_groups(J._seen(p, asked), "id").groupBy("title", "_handle").count().collect()
    assert len(kinds) == 3  # the asked number makes a kind of its own
    got = J.score_products(p, asked).groupBy("query_id").agg({"id": "count", "kw": "sum"}).collect()
    assert len(got) == 40 and {r["count(id)"] for r in got} == {3000}
    best = J.best_scores(p, asked, 5).collect()
    assert sorted(r["id"] for r in best if r["query_id"] == 7) == [0, 2, 4, 6, 8]
    assert [(r["id"], r["rank"]) for r in best if r["query_id"] == 39] == [(1234, 1)]


def test_groups_stay_small_and_keep_every_key(spark):
    rows = spark.range(2500).selectExpr("id", "if(id < 2400, 'a', NULL) AS look", "array('x') AS words")
    got = J.in_groups(rows, "id", 100).collect()
    assert sorted(k for r in got for k in r["ids"]) == list(range(2500)) and max(len(r["ids"]) for r in got) < 200


def test_gate_expands_groups_of_equal_words(spark):
    p = alike(spark, 2000)
    asked = M.saved(J.expand_queries(spark.range(30).selectExpr("id AS query_id", "if(id % 3 = 0, 'rings and plates', 'ring') AS text")))
    got = J.intent_gate(asked, p)
    assert got.count() == got.distinct().count() == 10 * 2000 + 20 * 1000
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString().split("Generate", 2)[0]  # pairs are never made distinct


def test_pairs_of_groups_become_few_rows_at_once(spark, monkeypatch):
    """Spark holds what comes from one row until its last is made, so no pair of groups may stand for a million."""
    p = alike(spark, 1800)
    asked = M.saved(J.expand_queries(spark.range(900).selectExpr("id AS query_id", "'ring' AS text")))
    dealt, spread = [], J.spread
    monkeypatch.setattr(J, "spread", lambda rows: dealt.append(rows) or spread(rows))
    gated, scored = J.intent_gate(asked, p), J.score_products(p, asked)
    assert gated.count() == gated.distinct().count() == 900 * 900 and scored.count() == 900 * 1800
    assert dealt[0].agg(F.max(F.size("ids") * F.size("query_ids"))).first()[0] < 200_000
    assert dealt[1].agg(F.max(F.size("ids"))).first()[0] < 200
