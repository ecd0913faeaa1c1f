"""Table-state and enrichment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import enrich as K
from .operators import feeds as D
from .operators import labels as L
from .operators import state as S
from .operators import vectors as V
from .queries import ledger, query, run_tables, tables
from .queries_catalog import _COUNTS, _FASHION_SQL, _FEED, _GENERAL_SQL, _JUNK_SQL, _SUB_SQL, _CAT_SQL
from .sources import model as M
from .sources.model import NOW

_STATE = ["id", "is_fashion", "subniche"]
_ACTIVE = "(is_fashion OR subniche <> '')"


def _retire(when: str, source: str = "products", extra: str = "") -> str:
    return f"SELECT id, is_fashion AND NOT ({when}) AS is_fashion, CASE WHEN {when} THEN '' ELSE subniche END AS subniche{extra} FROM {source}"


def _demote(source: str = "products") -> str:
    hit = f"is_fashion AND {_GENERAL_SQL}"
    return f"SELECT * REPLACE (is_fashion AND NOT ({hit}) AS is_fashion, CASE WHEN {hit} THEN {_SUB_SQL} ELSE subniche END AS subniche) FROM {source}"


def _promote(source: str = "products") -> str:
    hit = f"NOT is_fashion AND {_FASHION_SQL} AND NOT {_GENERAL_SQL}"
    return f"SELECT * REPLACE (is_fashion OR ({hit}) AS is_fashion, CASE WHEN ({hit}) AND subniche NOT IN ('fashion', 'bags', 'accessories', 'jewelry') THEN 'fashion' ELSE subniche END AS subniche) FROM {source}"


def _junk(source: str = "products") -> str:
    return f"SELECT * REPLACE (is_fashion AND NOT ({_JUNK_SQL}) AS is_fashion, CASE WHEN {_JUNK_SQL} THEN '' ELSE subniche END AS subniche) FROM {source}"


def _cap(source: str, cap: int) -> str:
    return f"SELECT * REPLACE (is_fashion AND current_position <= {cap} AS is_fashion, CASE WHEN current_position > {cap} THEN '' ELSE subniche END AS subniche) FROM {source}"


for _name, _function, _sql in (
    ("g4_junk_sweep", S.sweep_junk, f"SELECT id, is_fashion, subniche FROM ({_junk()})"), ("g5_demote_sweep", S.sweep_demote, f"SELECT id, is_fashion, subniche FROM ({_demote()})"),
    ("g6_promote_sweep", S.sweep_promote, f"SELECT id, is_fashion, subniche FROM ({_promote()})"), ("g7_off_cap_sweep", lambda df: S.sweep_off_cap(df, 150), f"SELECT id, is_fashion, subniche FROM ({_cap('products', 150)})"),
    ("g9_promote_wearables", S.promote_wearables, "SELECT id, is_fashion OR subniche IN ('bags', 'accessories', 'jewelry') AS is_fashion, subniche FROM products"),
):

    @query(_name, _sql)
    def g_sweep(spark, folder, function=_function):
        return function(M.products(spark, folder)).select(*_STATE)


@query("g10_category_backfill", f"SELECT id, CASE WHEN product_category = '' THEN {_CAT_SQL} ELSE product_category END AS product_category FROM products")
def g10(spark, folder):
    return S.backfill_category(M.products(spark, folder)).select("id", "product_category")


@query("d12_sweep_counts", f"WITH a AS ({_junk()}) SELECT count(*) FILTER (WHERE a.is_fashion <> p.is_fashion OR a.subniche <> p.subniche) AS touched, count(*) FILTER (WHERE NOT (a.is_fashion OR a.subniche <> '') AND (p.is_fashion OR p.subniche <> '')) AS retired, count(*) FILTER (WHERE a.is_fashion AND NOT p.is_fashion) AS promoted, count(*) FILTER (WHERE NOT a.is_fashion AND p.is_fashion AND a.subniche <> '') AS demoted FROM a JOIN products p USING (id)")
def d12(spark, folder):
    p = M.products(spark, folder)
    return S.sweep_counts(p, S.sweep_junk(p))


def scraped(spark, folder):
    """A scrape: parts not divisible by seven, a few of them under new handles, moved by three places."""
    p = M.products(spark, folder).where("id % 7 <> 0")
    handle = F.when(F.col("id") % 50 == 1, F.concat("handle", F.lit("-new"))).otherwise(F.col("handle"))
    return p.withColumns({"handle": handle, "current_position": F.col("current_position") + 3}).select("store_id", *S.OVERWRITTEN)


_SCRAPED = "scraped AS (SELECT store_id, CASE WHEN id % 50 = 1 THEN handle || '-new' ELSE handle END AS handle, title, image_url, price, vendor, product_type, ai_tags, current_position + 3 AS current_position, is_fashion, CASE WHEN is_fashion THEN CASE WHEN subniche IN ('fashion', 'jewelry') THEN subniche ELSE 'fashion' END WHEN subniche IN ('home', 'other') THEN subniche ELSE 'other' END AS subniche FROM products WHERE id % 7 <> 0)"
_MERGED = _SCRAPED + """, merged AS (SELECT coalesce(p.store_id, s.store_id) AS store_id, coalesce(p.handle, s.handle) AS handle, CASE WHEN s.handle IS NULL THEN p.title ELSE s.title END AS title, CASE WHEN s.handle IS NULL THEN p.product_type ELSE s.product_type END AS product_type,
  CASE WHEN s.handle IS NULL THEN p.current_position ELSE s.current_position END AS current_position, CASE WHEN s.handle IS NULL THEN p.is_fashion ELSE s.is_fashion END AS is_fashion, CASE WHEN s.handle IS NULL THEN p.subniche ELSE s.subniche END AS subniche,
  p.product_category AS old_category, p.embedding IS NOT NULL AS has_vector, p.handle IS NOT NULL AS existed, s.handle IS NOT NULL AS listed FROM products p FULL JOIN scraped s ON s.store_id = p.store_id AND s.handle = p.handle)"""


@query("g2_product_upsert", "WITH " + _MERGED.replace("CASE WHEN is_fashion THEN CASE WHEN subniche IN ('fashion', 'jewelry') THEN subniche ELSE 'fashion' END WHEN subniche IN ('home', 'other') THEN subniche ELSE 'other' END AS subniche", "subniche") + f" SELECT store_id, handle, current_position, is_fashion, subniche, CASE WHEN listed THEN {_CAT_SQL} ELSE old_category END AS product_category, has_vector, existed, listed FROM merged")
def g2(spark, folder):
    state = S.upsert_products(M.products(spark, folder, True), scraped(spark, folder), now=NOW)
    return state.select("store_id", "handle", "current_position", "is_fashion", "subniche", "product_category", F.col("embedding").isNotNull().alias("has_vector"), "existed", "listed")


_OLD = "(SELECT * FROM merged WHERE existed)"
_SWEPT = f"swept AS ({_cap('(' + _promote('(' + _demote('(' + _junk(_OLD) + ')') + ')') + ')', 180)} UNION ALL SELECT * FROM merged WHERE NOT existed)"
_ENOUGH = "quota AS (SELECT store_id, count(*) FILTER (WHERE is_fashion) AS nf, count(*) FILTER (WHERE NOT is_fashion) AS ng FROM scraped GROUP BY 1)"
_AFTER = f"after AS (SELECT store_id, handle, listed, current_position, is_fashion AND NOT absent AS is_fashion, CASE WHEN absent THEN '' ELSE subniche END AS subniche FROM (SELECT *, NOT listed AND coalesce(CASE WHEN is_fashion THEN nf ELSE ng END >= 5, false) AS absent FROM swept LEFT JOIN quota USING (store_id)))"


@query("g3_g8_scrape_application", f"WITH {_MERGED}, {_SWEPT}, {_ENOUGH}, {_AFTER} SELECT store_id, handle, current_position, is_fashion, subniche FROM after")
def g3(spark, folder):
    state = S.apply_scrape(M.products(spark, folder), scraped(spark, folder), now=NOW, cap=180)
    return state.select("store_id", "handle", "current_position", "is_fashion", "subniche")


@query("a8_history_append", f"WITH {_MERGED}, {_SWEPT}, {_ENOUGH}, {_AFTER} SELECT store_id, current_position AS position, TIMESTAMP '{NOW}' AS date FROM after WHERE listed")
def a8(spark, folder):
    state = S.apply_scrape(M.products(spark, folder), scraped(spark, folder), now=NOW, cap=180)
    return S.append_history(state, now=NOW).select("store_id", "position", "date")


@query("g8_retire_absent", f"WITH {_SCRAPED}, {_ENOUGH} SELECT id, p.is_fashion AND NOT absent AS is_fashion, CASE WHEN absent THEN '' ELSE subniche END AS subniche FROM (SELECT p.*, {_ACTIVE} AND NOT EXISTS (SELECT 1 FROM scraped s WHERE s.store_id = p.store_id AND s.handle = p.handle) AND coalesce(CASE WHEN p.is_fashion THEN nf ELSE ng END >= 5, false) AS absent FROM products p LEFT JOIN quota USING (store_id)) p")
def g8(spark, folder):
    return S.retire_absent(M.products(spark, folder), scraped(spark, folder)).select(*_STATE)


@query("g11_c8_force_promote", "SELECT id, handle, is_fashion AS before_fashion, subniche AS before_subniche, true AS after_fashion, CASE WHEN subniche IN ('fashion', 'bags', 'accessories', 'jewelry') THEN subniche ELSE 'fashion' END AS after_subniche FROM products WHERE id % 11 = 3")
def g11(spark, folder):
    p = M.products(spark, folder)
    return S.force_promote(p, p.where("id % 11 = 3"))


_CHANGES = "changes AS (SELECT CASE WHEN id % 4 = 0 THEN NULL ELSE id END AS id, CASE WHEN id % 5 = 0 THEN ' ' WHEN id % 4 = 1 THEN NULL ELSE name || ' shop' END AS name, CASE WHEN id % 3 = 0 THEN url || '/collections' WHEN id % 3 = 1 THEN replace(url, 'supplier', 'shop') ELSE NULL END AS url, id AS k FROM stores)"


@query("g12_store_upsert", "WITH " + _CHANGES + """, o AS (SELECT c.id, coalesce(c.name, s.name) AS name, coalesce(c.url, s.url) AS url FROM changes c LEFT JOIN stores s ON s.id = c.id),
 v AS (SELECT *, CASE WHEN trim(coalesce(name, '')) = '' THEN 'Store name is required' WHEN trim(coalesce(url, '')) = '' THEN 'Store URL is required' END AS reason, coalesce(regexp_extract(url, '^(https://[^/]+)', 1), '') AS clean FROM o)
 SELECT id, trim(name) AS name, clean AS url, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN EXISTS (SELECT 1 FROM stores s WHERE s.url = v.clean AND (v.id IS NULL OR v.id <> s.id)) THEN 'conflict' ELSE 'accepted' END AS status, reason FROM v""")
def g12(spark, folder):
    stores = M.stores(spark, folder)
    changes = stores.selectExpr("CASE WHEN id % 4 = 0 THEN NULL ELSE id END AS id", "CASE WHEN id % 5 = 0 THEN ' ' WHEN id % 4 = 1 THEN NULL ELSE concat(name, ' shop') END AS name", "CASE WHEN id % 3 = 0 THEN concat(url, '/collections') WHEN id % 3 = 1 THEN replace(url, 'supplier', 'shop') ELSE NULL END AS url")
    return S.upsert_stores(stores, changes)


@query("g13_cascading_delete", "SELECT 'stores' AS \"table\", count(*) FILTER (WHERE id <> 0) AS rows FROM stores UNION ALL SELECT 'products', count(*) FILTER (WHERE store_id <> 0) FROM products UNION ALL SELECT 'history', count(*) FILTER (WHERE store_id <> 0) FROM history UNION ALL SELECT 'events', count(*) FILTER (WHERE store_id <> 0) FROM ledger")
def g13(spark, folder):
    stores, products, history = tables(spark, folder)
    return S.row_counts(S.delete_store(0, stores, products, history, ledger(spark, folder)))


@query("g14_history_retention", f"SELECT * FROM history WHERE date >= TIMESTAMP '{NOW}' - INTERVAL 12 DAYS")
def g14(spark, folder):
    return L.keep_recent(M.history(spark, folder), now=NOW, days=12)


@query("g15_reset_counts", "SELECT 'products' AS \"table\", count(*) AS removed, 0 AS rows FROM products UNION ALL SELECT 'history', count(*), 0 FROM history UNION ALL SELECT 'events', count(*), 0 FROM ledger")
def g15(spark, folder):
    _, products, history, events = run_tables(spark, folder)
    before = S.row_counts({"products": products, "history": history, "events": events}).withColumnRenamed("rows", "removed")
    return before.join(S.row_counts(S.reset(products, history, events)), "table")


@query("c9_orphans", "SELECT 'products' AS \"table\", count(*) FILTER (WHERE store_id = 1) AS rows FROM products UNION ALL SELECT 'history', count(*) FILTER (WHERE product_id % 3 = 0) FROM history UNION ALL SELECT 'events', count(*) FILTER (WHERE product_id % 3 = 0) FROM ledger")
def c9(spark, folder):
    stores, products, history = tables(spark, folder)
    found = S.orphans(stores.where("id <> 1"), products, history.where("false"), ledger(spark, folder).where("false"))
    held = S.orphans(stores, products.where("id % 3 <> 0"), history, ledger(spark, folder))
    return found.where("table = 'products'").unionByName(held.where("table <> 'products'"))


@query("maintenance_chain", f"SELECT id, is_fashion, subniche, CASE WHEN product_category = '' THEN {_CAT_SQL} ELSE product_category END AS product_category FROM ({_cap('(' + _demote('(' + _promote('(SELECT * REPLACE (is_fashion OR subniche IN (' + chr(39) + 'jewelry' + chr(39) + ') AS is_fashion) FROM (' + _junk() + '))') + ')') + ')', 600)})")
def chain(spark, folder):
    return S.maintain(M.products(spark, folder)).select("id", "is_fashion", "subniche", "product_category")


@query("a7_seed_if_empty", "SELECT id, name FROM stores WHERE id < 5")
def a7(spark, folder):
    stores = M.stores(spark, folder)
    return S.seed_if_empty(stores.where("false"), stores.where("id < 5")).select("id", "name")


@query("a9_vector_codec", "SELECT id, len(embedding) AS size, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[len(embedding)] AS DOUBLE), 6) AS last, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total_binary, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total_json, CASE WHEN id % 2 = 0 THEN NULL ELSE len(embedding) END AS size_or_bad FROM products WHERE embedding IS NOT NULL")
def a9(spark, folder):
    own = M.products(spark, folder, True).where("embedding IS NOT NULL")
    packed = own.withColumns({"b": V.encode_vector(F.col("embedding")), "j": F.to_json("embedding")})
    back = packed.withColumns({"from_b": V.parse_vector(F.col("b")), "from_j": V.parse_vector(F.col("j")), "mixed": V.parse_vector(F.when(F.col("id") % 2 == 0, F.concat(F.lit("b64:!"), "handle")).otherwise(F.col("b")))})
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double")), 5)
    first, last = F.col("from_b")[0].cast("double"), F.element_at("from_j", -1).cast("double")
    return back.select("id", F.size("from_b").alias("size"), F.round(first, 6).alias("first"), F.round(last, 6).alias("last"), total("from_b").alias("total_binary"), total("from_j").alias("total_json"), F.when(F.col("mixed").isNotNull(), F.size("mixed")).alias("size_or_bad"))


@query("a10_latest_index", "SELECT id, round(list_sum(list_transform(unit, lambda x: x * x)), 6) AS norm2, round(unit[1], 6) AS first FROM (SELECT id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS unit FROM (SELECT * FROM products WHERE embedding IS NOT NULL ORDER BY last_scraped DESC, id LIMIT 12000))")
def a10(spark, folder):
    index = V.load_index(M.products(spark, folder, True))
    return index.select("id", F.round(V.dot(F.col("unit"), F.col("unit")), 6).alias("norm2"), F.round(F.col("unit")[0], 6).alias("first"))


@query("f4_vector_top_k", "SELECT query_id, id, sim, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND e.label < 6) WHERE rank <= 10")
def f4(spark, folder):
    rows = M.read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), V.normalised(F.col("embedding")).alias("unit"), "label")
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "unit")
    return V.vector_top_k(rows.select("id", "unit"), asked, 10, rows.where("label < 6").select("id"))


_RESULTS = "SELECT doc_id AS id, quality, toxic FROM labels"


@query("k7_embedding_merge", "SELECT p.id, coalesce(e.embedding IS NOT NULL, false) OR p.embedding IS NOT NULL AS has_vector, CASE WHEN e.vec_id IS NULL THEN NULL ELSE p.title END AS embedding_text FROM products p LEFT JOIN (SELECT * FROM embeddings WHERE vec_id % 2 = 0) e ON e.vec_id = p.id")
def k7(spark, folder):
    p = M.products(spark, folder, True)
    results = M.read(spark, folder, "embeddings").where("vec_id % 2 = 0").selectExpr("vec_id AS id", "embedding").join(p.select("id", F.col("title").alias("embedding_text")), "id")
    merged = V.merge_results(p, results, ("embedding", "embedding_text"))
    return merged.select("id", F.col("embedding").isNotNull().alias("has_vector"), "embedding_text")


@query("k1_k2_batched_classification", "SELECT id, CASE WHEN id % 13 = 0 THEN is_fashion ELSE title LIKE '%ring%' END AS is_fashion, CASE WHEN id % 13 = 0 THEN subniche WHEN title LIKE '%ring%' THEN 'jewelry' ELSE 'other' END AS subniche, ai_tags FROM products")
def k1(spark, folder):
    def classify(rows: list[dict]) -> list:
        return [None if r["id"] % 13 == 0 else {"is_fashion": "ring" in r["title"], "subniche": "jewelry" if "ring" in r["title"] else "other", "tags": None} for r in rows]

    p = M.products(spark, folder)
    return K.merge_classes(p, K.batched_scores(p, classify, ("title",), "is_fashion boolean, subniche string, tags string")).select("id", "is_fashion", "subniche", "ai_tags")


@query("k3_unclassified", "SELECT p.id, p.store_id, CASE WHEN quality IS NOT NULL AND p.store_id <> 0 THEN 'kept' WHEN NOT coalesce(any_known, false) THEN 'failed' ELSE 'dropped' END AS status FROM products p LEFT JOIN labels ON doc_id = p.id LEFT JOIN (SELECT store_id, bool_or(quality IS NOT NULL AND store_id <> 0) AS any_known FROM products LEFT JOIN labels ON doc_id = id GROUP BY 1) s ON s.store_id = p.store_id")
def k3(spark, folder):
    found = M.read(spark, folder, "labels").selectExpr("doc_id AS id", "quality = 1 AS f")
    results = M.products(spark, folder).select("id", "store_id").join(found, "id", "left").select("id", "store_id", F.when(F.col("store_id") != 0, F.col("f")).alias("is_fashion"))
    return K.unclassified(results).select("id", "store_id", "status")


@query("k4_no_model", f"SELECT id, true AS is_fashion FROM products WHERE NOT {_JUNK_SQL}")
def k4(spark, folder):
    return K.without_model(M.products(spark, folder)).select("id", "is_fashion")


@query("k5_reclassify_general", f"SELECT p.id, true AS is_fashion, 'fashion' AS subniche FROM products p JOIN labels ON doc_id = p.id WHERE toxic = 1 AND {_FEED[False]} AND NOT {_JUNK_SQL}")
def k5(spark, folder):
    flagged = M.read(spark, folder, "labels").selectExpr("doc_id AS id", "toxic = 1 AS wearable")
    return K.reclassify_general(M.products(spark, folder), flagged, dry_run=False).select(*_STATE)


@query("k6_vision_merge", f"SELECT p.id, CASE WHEN doc_id IS NULL THEN ai_tags ELSE 'img:type:boots, img:boots, img:gender:women, img:color:red, img:attr:tall, img:tall' || CASE WHEN ai_tags IS NULL THEN '' ELSE ' || ' || vendor || ', ' || lower(product_type) END END AS ai_tags, CASE WHEN doc_id IS NULL THEN NULL ELSE 'seen ' || p.id END AS vision_description, CASE WHEN doc_id IS NULL THEN vision_classified_at ELSE TIMESTAMP '{NOW}' END AS vision_classified_at, is_fashion AND coalesce(quality, 1) = 1 AS is_fashion, CASE WHEN coalesce(quality, 1) = 0 THEN '' ELSE subniche END AS subniche FROM products p LEFT JOIN labels ON doc_id = p.id")
def k6(spark, folder):
    results = M.read(spark, folder, "labels").selectExpr("doc_id AS id", "'Boots' AS kind", "'women' AS gender", "'Red,red' AS colors", "'tall' AS attributes", "concat('seen ', doc_id) AS description", "quality = 1 AS is_product")
    return K.merge_vision(M.products(spark, folder), results, now=NOW).select("id", "ai_tags", "vision_description", "vision_classified_at", "is_fashion", "subniche")


@query("c13_j11_verdicts", "SELECT p.id, title FROM products p JOIN labels ON doc_id = p.id WHERE quality = 1 OR toxic = 1")
def c13(spark, folder):
    first = M.read(spark, folder, "labels").selectExpr("doc_id AS id", "quality = 1 AS match", "toxic = 1 AS failed", "0 AS seq")
    again = first.selectExpr("id", "NOT match AS match", "false AS failed", "1 AS seq")
    return K.verdicts(M.products(spark, folder).select("id", "title"), first.unionByName(again))


@query("d11_run_summary", f"WITH {_COUNTS} SELECT count(*) AS stores, count(*) FILTER (WHERE fashion_count + general_count > 0) AS stores_ok, count(*) FILTER (WHERE fashion_count + general_count = 0) AS stores_failed, CAST(sum(fashion_count) AS BIGINT) AS fashion, CAST(sum(general_count) AS BIGINT) AS general FROM counts")
def d11(spark, folder):
    return K.run_summary(D.store_counts(*tables(spark, folder)[:2]))


@query("d13_error_summary", "WITH f AS (SELECT id, store_id, title, 'bad ' || product_type AS message FROM products WHERE id % 4 = 1), m AS (SELECT store_id, message, row_number() OVER (PARTITION BY store_id ORDER BY min(id)) AS n FROM f GROUP BY 1, 2), t AS (SELECT store_id, title, row_number() OVER (PARTITION BY store_id ORDER BY id) AS n FROM f) SELECT store_id, count(*) AS missing, (SELECT string_agg(message, '; ' ORDER BY n) FROM m WHERE n <= 3 AND m.store_id = f.store_id) AS messages, (SELECT string_agg(title, '; ' ORDER BY n) FROM t WHERE n <= 5 AND t.store_id = f.store_id) AS sample FROM f GROUP BY store_id")
def d13(spark, folder):
    failures = M.products(spark, folder).where("id % 4 = 1").selectExpr("id", "store_id", "title", "concat('bad ', product_type) AS message")
    return K.error_summary(failures)


@query("a12_versioned_state", "SELECT id, is_fashion, subniche, store_id FROM products")
def a12(spark, folder):
    """The older version is other, and one that was never finished isn't seen."""
    state, path = M.products(spark, folder).select("id", "is_fashion", "subniche", "store_id"), M.new_folder(spark)
    S.write_state(state.where("is_fashion"), path, 1, order_by=("store_id", "id"))
    S.write_state(state, path, 2, order_by=("store_id", "id"))
    return S.newest_state(spark, path)
