"""Catalog, feed and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as X
from .operators import feeds as D
from .operators import labels as L
from .operators import rules as R
from .queries import FLOORS, ledger, query, run_tables, tables
from .sources import model as M
from .sources.model import NOW, START

_NICHE = "(lower(niche) LIKE '%&%' OR lower(niche) LIKE '%multi%' OR lower(niche) LIKE '%mixed%')"
_FEED = {True: "is_fashion", False: "(NOT is_fashion AND subniche <> '')"}
_VISITORS = "CASE WHEN monthly_visitors LIKE '%K' THEN CAST(floor(CAST(replace(monthly_visitors, 'K', '') AS DOUBLE) * 1000) AS BIGINT) WHEN regexp_full_match(monthly_visitors, '[0-9]+') THEN CAST(monthly_visitors AS BIGINT) ELSE 0 END"
_COUNTS = f"counts AS (SELECT s.id, s.name, s.niche, coalesce(f, 0) AS fashion_count, coalesce(g, 0) AS general_count, last_scraped FROM stores s LEFT JOIN (SELECT store_id, count(*) FILTER (WHERE {_FEED[True]}) AS f, count(*) FILTER (WHERE {_FEED[False]}) AS g, max(last_scraped) AS last_scraped FROM products GROUP BY 1) c ON c.store_id = s.id)"


@query("a1_scan_products", "SELECT id, store_id, handle, title, current_position FROM products")
def a1(spark, folder):
    return M.products(spark, folder).select("id", "store_id", "handle", "title", "current_position")


_TITLE = "CASE p_partkey % 6 WHEN 0 THEN '  SALE ' WHEN 1 THEN '{\"id\":1}' WHEN 2 THEN repeat('x', 301) WHEN 3 THEN '-' || p_size || ' %' ELSE '  ' || replace(p_name, ' ', '   ') || ' ' END"


@query("a5_clean_title", f"SELECT id, CASE WHEN id % 6 < 4 THEN '' ELSE trim(regexp_replace(t, '\\s+', ' ', 'g')) END AS title FROM (SELECT p_partkey AS id, {_TITLE} AS t FROM part)")
def a5(spark, folder):
    return M.read(spark, folder, "part").select(F.col("p_partkey").alias("id"), X.clean_title(F.expr(_TITLE)).alias("title"))


@query("a6_image_url", "SELECT id, 'https:' || image_url AS image_url, CASE WHEN id % 2 = 0 THEN '/' || handle ELSE '' END AS other FROM products")
def a6(spark, folder):
    p = M.products(spark, folder)
    other = F.when(F.col("id") % 2 == 0, F.concat(F.lit("/"), "handle")).otherwise(F.col("handle"))
    return p.select("id", X.image_url(F.col("image_url")).alias("image_url"), X.image_url(other).alias("other"))


@query("a11_pending_vectors", "SELECT id FROM products WHERE embedding IS NULL AND store_id = 0 ORDER BY last_scraped DESC, id LIMIT 50")
def a11(spark, folder):
    from .operators.vectors import pending

    return pending(M.products(spark, folder, True), "embedding", store_id=0, limit=50).select("id")


@query("a11_pending_vision", f"SELECT id FROM products WHERE vision_classified_at IS NULL AND {_FEED[False]}")
def a11v(spark, folder):
    from .operators.vectors import pending

    return pending(M.products(spark, folder), "vision_classified_at", is_fashion=False).select("id")


_CARD_SQL = "SELECT {p}.id, title, handle, image_url, price, vendor, product_type, current_position, coalesce(ai_tags, '') AS ai_tags, subniche, product_category, is_fashion, store_id, s.name AS store_name, s.url AS store_url, niche, {label}"


@query("b1_c1_product_cards", _CARD_SQL.format(p="p", label="'new' AS label, 0 AS position_change, 0 AS prior_position") + " FROM products p JOIN stores s ON s.id = store_id")
def b1(spark, folder):
    stores, products, _ = tables(spark, folder)
    return D.cards(D.with_store(products, stores))


_EVENTS = "ev AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY date DESC) AS rn FROM ledger WHERE label = '{label}' AND date >= DATE '2024-01-24') WHERE rn = 1)"
_EVENT_CARD = "SELECT p.id, title, handle, image_url, price, vendor, product_type, p.current_position, coalesce(ai_tags, '') AS ai_tags, subniche, product_category, is_fashion, p.store_id, s.name AS store_name, s.url AS store_url, niche, label, position_change, prior_position, date AS event_date, {active} AS is_active FROM ev JOIN products p ON p.id = ev.product_id JOIN stores s ON s.id = p.store_id"


@query("b2_c5_event_cards", "WITH " + _EVENTS.format(label="villain") + " " + _EVENT_CARD.format(active=_FEED[False]))
def b2(spark, folder):
    stores, products, _, own = run_tables(spark, folder)
    events = L.event_window(own, products, label="villain", days=7, now=NOW, start=START)
    return D.event_cards(events, stores, False)


@query("b3_b4_store_feed_filter", f"SELECT id, title FROM products WHERE {_FEED[False]} AND store_id = 0")
def b3(spark, folder):
    return M.products(spark, folder).where(D.in_feed(False) & (F.col("store_id") == 0)).select("id", "title")


@query("b5_store_url", "SELECT id, url AS clean, '' AS blank FROM stores")
def b5(spark, folder):
    s = M.stores(spark, folder)
    messy = F.when(F.col("id") % 2 == 0, F.concat(F.lit("  "), F.replace("url", F.lit("https://"), F.lit("")), F.lit("/collections/all?x#y "))).otherwise(F.concat("url", F.lit("/a/b")))
    return s.select("id", X.store_url(messy).alias("clean"), X.store_url(F.lit("   ")).alias("blank"))


@query("b6_store_validation", "SELECT id, CASE id % 5 WHEN 0 THEN 'Store name is required' WHEN 1 THEN 'Store name must be 255 characters or fewer' WHEN 2 THEN 'Store URL is required' WHEN 3 THEN 'Store URL host looks invalid (missing TLD?)' END AS reject_reason FROM stores")
def b6(spark, folder):
    s, k = M.stores(spark, folder), F.col("id") % 5
    name = F.when(k == 0, " ").when(k == 1, F.repeat(F.lit("x"), 256)).otherwise(F.col("name"))
    url = F.when(k == 2, F.lit(None)).when(k == 3, "nohost").otherwise(F.col("url"))
    return s.select("id", X.reject_reason(name, url).alias("reject_reason"))


@query("b7_visitors", f"SELECT id, {_VISITORS} AS visitors FROM stores")
def b7(spark, folder):
    return M.stores(spark, folder).select("id", X.visitors(F.col("monthly_visitors")).alias("visitors"))


_JUNK_SQL = "(regexp_matches(title, '\\b(gift card|shipping protection|warranty|anvil)\\b', 'i') OR regexp_matches(product_type, '\\b(insurance|donation)\\b', 'i'))"
_GENERAL_SQL = "(regexp_matches(title || ' ' || handle, '\\b(smartwatch|lamp|gear|gizmo)\\b', 'i'))"
_FASHION_SQL = "(regexp_matches(title, '\\b(dress|sneakers?|ring|rod|red widget)\\b', 'i') OR regexp_matches(handle, '\\b(dress|sneakers?|ring|rod)\\b', 'i'))"
_SUB_SQL = "CASE WHEN title LIKE '%gizmo%' THEN 'electronics' WHEN title LIKE '%plate%' THEN 'home' WHEN title LIKE '%gear%' THEN 'toys-books' ELSE 'other' END"
_CAT_SQL = "CASE WHEN title LIKE '%ring%' THEN 'ring' WHEN title LIKE '%bolt%' THEN 'bolt' WHEN title LIKE '%gear%' OR title LIKE '%anvil%' THEN 'gear' WHEN title LIKE '%plate%' THEN 'plate' WHEN title LIKE '%red widget%' THEN 'red-widget' WHEN title LIKE '%widget%' THEN 'widget' ELSE '' END"


@query("b8_non_product_filter", f"SELECT id, title FROM products WHERE NOT {_JUNK_SQL}")
def b8(spark, folder):
    p = M.products(spark, folder)
    return p.where(~R.is_junk(p)).select("id", "title")


@query("b9_b10_forced_feeds", f"SELECT id, {_GENERAL_SQL} AS forced_general, {_FASHION_SQL} AS forced_fashion FROM products")
def b9(spark, folder):
    p = M.products(spark, folder)
    return p.select("id", R.forced_general(p).alias("forced_general"), R.forced_fashion(p).alias("forced_fashion"))


@query("b11_general_subniche", f"SELECT id, {_SUB_SQL} AS sub FROM products")
def b11(spark, folder):
    return M.products(spark, folder).select("id", R.general_subniche(F.col("title")).alias("sub"))


@query("b12_category", f"SELECT id, {_CAT_SQL} AS category FROM products")
def b12(spark, folder):
    p = M.products(spark, folder)
    return p.select("id", R.assign_category(p).alias("category"))


@query("b12_phrase_catalog", f"SELECT id, {_CAT_SQL} AS category FROM products")
def b12p(spark, folder):
    """The same categories from phrases; as many again that no product has come before them."""
    p = M.products(spark, folder)
    others = tuple((f"none-{k}", "none", (f"unheard {k} thing", f"thing {k}")) for k in range(len(R.PHRASES)))
    return p.select("id", R.phrase_categories(p, others + R.PHRASES).alias("category"))


_ROUTED = f"""routed AS (SELECT id, title, store_id, handle, CASE WHEN g THEN false WHEN f OR w THEN true ELSE is_fashion END AS is_fashion,
  CASE WHEN g AND (w OR subniche = '') THEN {_SUB_SQL} WHEN f AND NOT g AND NOT w THEN 'fashion' ELSE subniche END AS subniche
  FROM (SELECT *, {_GENERAL_SQL} AS g, {_FASHION_SQL} AS f, subniche IN ('fashion', 'bags', 'accessories', 'jewelry') AS w FROM products WHERE NOT {_JUNK_SQL}))"""


@query("b13_feed_routing", f"WITH {_ROUTED} SELECT id, is_fashion, subniche FROM routed")
def b13(spark, folder):
    return R.route(M.products(spark, folder)).select("id", "is_fashion", "subniche")


@query("b14_sane_subniche", "SELECT id, CASE WHEN is_fashion THEN CASE WHEN subniche IN ('fashion', 'bags', 'accessories', 'jewelry') THEN subniche ELSE 'fashion' END WHEN subniche IN ('home', 'other') THEN subniche ELSE 'other' END AS sub FROM products")
def b14(spark, folder):
    return M.products(spark, folder).select("id", R.sane_subniche(F.col("is_fashion"), F.col("subniche")).alias("sub"))


@query("b15_gender_filter", "SELECT id, title FROM products WHERE title NOT LIKE '% for men'")
def b15(spark, folder):
    p = M.products(spark, folder)
    return p.where(~X.gender_contradiction(F.lit("ring for women"), F.concat_ws(" ", "title", "ai_tags"))).select("id", "title")


@query("b16_whole_word", "SELECT id FROM products WHERE regexp_matches(title, '\\bring\\b', 'i')")
def b16(spark, folder):
    return M.products(spark, folder).where(X.whole_word(F.col("title"), "Ring")).select("id")


@query("b17_loose_word", "SELECT id FROM products WHERE lower(coalesce(ai_tags, '')) LIKE '%brand#1%'")
def b17(spark, folder):
    return M.products(spark, folder).where(X.loose_word(F.col("ai_tags"), "brand#1")).select("id")


@query("b18_render_tags", "SELECT id, 'img:type:' || split_part(title, ' ', 2) || ', img:' || split_part(title, ' ', 2) || ', img:gender:men, img:color:' || split_part(title, ' ', 1) || ', img:color:red2, img:attr:' || lower(product_type) || ', img:' || lower(product_type) || ' || ' || vendor AS tags FROM products")
def b18(spark, folder):
    noun, color = F.split_part("title", F.lit(" "), F.lit(2)), F.split_part("title", F.lit(" "), F.lit(1))
    tags = X.render_tags(noun, F.lit(" Men "), F.lit(None).cast("string"), F.concat(color, F.lit(", Red2,"), color), F.lit(""), F.lit(""), F.col("product_type"), F.col("vendor"))
    return M.products(spark, folder).select("id", tags.alias("tags"))


_B19 = "CASE WHEN ai_tags IS NULL THEN '' ELSE split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1) || ', ' || lower(vendor) || CASE WHEN lower(product_type) = split_part(p_name, ' ', 1) THEN '' ELSE ', ' || lower(product_type) END END"


@query("b19_clean_tags", f"SELECT id, {_B19} AS tags FROM products JOIN part ON id = p_partkey")
def b19(spark, folder):
    return M.products(spark, folder).select("id", X.clean_tags(F.col("ai_tags")).alias("tags"))


@query("b20_embedding_text", f"SELECT id, title || CASE WHEN id % 2 = 0 THEN '. about ' || handle ELSE '' END || CASE WHEN ai_tags IS NULL THEN '' ELSE '. ' || ({_B19}) END AS embedding_text FROM products JOIN part ON id = p_partkey")
def b20(spark, folder):
    description = F.when(F.col("id") % 2 == 0, F.concat(F.lit("about "), "handle")).otherwise("  ")
    return M.products(spark, folder).select("id", X.embedding_text(F.col("title"), description, F.col("ai_tags")).alias("embedding_text"))


@query("b21_image_file", "SELECT id, replace(p_name, ' ', '_') || '.jpg' AS file FROM products JOIN part ON id = p_partkey")
def b21(spark, folder):
    return M.products(spark, folder).select("id", X.image_file(F.col("image_url")).alias("file"))


@query("b22_b23_scrape_warning", f"WITH {_COUNTS} SELECT id, {_NICHE} AS expects_both, CASE WHEN fashion_count = 0 AND general_count = 0 THEN 'Dead scrape — both feeds empty' WHEN NOT {_NICHE} THEN NULL WHEN fashion_count = 0 THEN 'Fashion feed empty (mixed-niche store expected to populate both)' WHEN general_count = 0 THEN 'General feed empty (mixed-niche store expected to populate both)' END AS warning FROM counts")
def b23(spark, folder):
    c = D.store_counts(*tables(spark, folder)[:2])
    return c.select("id", X.expects_both(F.col("niche")).alias("expects_both"), X.scrape_warning(F.col("niche"), F.col("fashion_count"), F.col("general_count")).alias("warning"))


@query("b24_epoch_guard", "SELECT 'before today' AS epoch, count(*) AS events FROM ledger WHERE date = DATE '2024-01-30' UNION ALL SELECT 'today', 0")
def b24(spark, folder):
    _, products, history = tables(spark, folder)
    counts = [L.events_of_today(products, history, now=NOW, epoch=epoch, start=START).agg(F.count("*").alias("events")).select(F.lit(name).alias("epoch"), "events") for name, epoch in (("before today", START), ("today", NOW))]
    return counts[0].unionByName(counts[1])


_LINKS = "links AS (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS store_id, lower(l) AS handle, slot FROM (SELECT page_id, url, unnest(ls) AS l, generate_subscripts(ls, 1) AS slot FROM (SELECT page_id, url, regexp_extract_all(html, '<a [^>]*href=\"/([^\"/]+)\"', 1) AS ls FROM pages)))"
_FIRST = _LINKS + ", firsts AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY store_id, handle ORDER BY page_id, slot) AS rn FROM links) WHERE rn = 1), placed AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY page_id, slot) AS source_position FROM firsts)"


def link_rows(spark, folder):
    from .sources.pages import link_items

    return link_items(M.read(spark, folder, "pages"), r'<a [^>]*href="/([^"/]+)"')


@query("a3_page_links", "WITH " + _LINKS + " SELECT page_id, store_id, handle, slot FROM links")
def a3(spark, folder):
    return link_rows(spark, folder).select("page_id", "store_id", "handle", "slot")


@query("e6_first_occurrence", "WITH " + _FIRST + " SELECT page_id, store_id, handle, slot FROM firsts")
def e6(spark, folder):
    return R.first_per_store(link_rows(spark, folder)).select("page_id", "store_id", "handle", "slot")


@query("e5_e7_source_position", "WITH " + _FIRST + " SELECT store_id, handle, source_position FROM placed WHERE source_position <= 600")
def e5(spark, folder):
    return R.source_positions(R.first_per_store(link_rows(spark, folder))).select("store_id", "handle", "source_position")


@query("e8_feed_quota", "WITH " + _FIRST + " SELECT store_id, handle, source_position, is_fashion FROM (SELECT *, row_number() OVER (PARTITION BY store_id, is_fashion ORDER BY source_position) AS rn FROM (SELECT *, length(handle) % 3 = 0 AS is_fashion FROM placed WHERE source_position <= 600)) WHERE rn <= 200")
def e8(spark, folder):
    placed = R.source_positions(R.first_per_store(link_rows(spark, folder))).withColumn("is_fashion", F.length("handle") % 3 == 0)
    return R.feed_quota(placed).select("store_id", "handle", "source_position", "is_fashion")


@query("d1_store_counts", f"WITH {_COUNTS} SELECT * FROM counts")
def d1(spark, folder):
    return D.store_counts(*tables(spark, folder)[:2])


_EV = lambda label: f"(SELECT count(DISTINCT product_id) FROM ledger JOIN products p ON p.id = product_id WHERE label = '{label}' AND date >= DATE '2024-01-17' AND is_fashion)"


@query("d3_statistics", f"SELECT (SELECT count(*) FROM stores) AS stores, (SELECT count(*) FROM products WHERE is_fashion) AS products, {_EV('hero')} AS heroes, {_EV('villain')} AS villains")
def d3(spark, folder):
    stores, products, _, events = run_tables(spark, folder)
    return D.statistics(stores, products, events, days=14, is_fashion=True, now=NOW, start=START)


@query("d4_unhealthy_stores", f"WITH {_COUNTS} SELECT id, name, CASE WHEN fashion_count = 0 AND general_count = 0 THEN 'dead' ELSE 'skewed' END AS status, fashion_count, general_count FROM counts WHERE (fashion_count = 0 AND general_count = 0) OR ({_NICHE} AND ((fashion_count > 100 AND general_count = 0) OR (general_count > 100 AND fashion_count = 0)))")
def d4(spark, folder):
    return D.unhealthy_stores(D.store_counts(*tables(spark, folder)[:2]))


_D5 = "SELECT h.store_id, s.name, CAST(date AS DATE) AS date, count(*) AS snapshots FROM history h JOIN stores s ON s.id = h.store_id WHERE CAST(date AS DATE) > DATE '2024-01-25' GROUP BY ALL"


@query("c6_d5_snapshot_histogram", _D5)
def d5(spark, folder):
    stores, products, history = tables(spark, folder)
    return D.snapshot_histogram(history, products, stores, now=NOW)


def labelled(spark, folder):
    _, products, history = tables(spark, folder)
    return L.movement_labels(products, history, **FLOORS)


_D6 = "WITH m AS (SELECT prior - current_position AS d, abs(prior - current_position) AS a FROM labelled WHERE prior > 0), s AS (SELECT list(a ORDER BY a) AS l FROM m) SELECT (SELECT count(*) FROM m) AS n, (SELECT min(a) FROM m) AS abs_min, (SELECT max(a) FROM m) AS abs_max, (SELECT count(*) FROM m WHERE a <= 30) AS within_cap, (SELECT count(*) FROM m WHERE a > 30) AS over_cap, (SELECT count(*) FROM m WHERE d > 0) AS up, (SELECT count(*) FROM m WHERE d < 0) AS down, (SELECT count(*) FROM m WHERE d = 0) AS same, l[len(l) // 2 + 1] AS abs_median, l[CAST(floor(len(l) * 0.9) AS INT) + 1] AS abs_p90 FROM s"


@query("d6_delta_summary", _D6)
def d6(spark, folder):
    return D.delta_summary(labelled(spark, folder))


_D7 = "SELECT count(*) AS total, count(*) FILTER (WHERE date < DATE '2024-01-10') AS before_start, count(*) FILTER (WHERE date >= DATE '2024-01-24') AS last_7, count(*) FILTER (WHERE date >= DATE '2024-01-17') AS last_14, count(*) FILTER (WHERE date >= DATE '2024-01-01') AS last_30, min(date) AS oldest, max(date) AS newest FROM ledger"


@query("d7_d8_event_windows", _D7)
def d7(spark, folder):
    return D.event_windows(ledger(spark, folder), now=NOW, start="2024-01-10")


_D9 = "SELECT date, label, count(*) AS events FROM ledger GROUP BY ALL"


@query("d9_events_per_day", _D9)
def d9(spark, folder):
    return D.events_per_day(ledger(spark, folder))


@query("d10_embedding_coverage", "SELECT count(*) AS total, count(embedding) AS with_vector, round(100.0 * count(embedding) / count(*), 1) AS pct FROM products")
def d10(spark, folder):
    return D.embedding_coverage(M.products(spark, folder, True))


_D15 = "SELECT count(*) FILTER (WHERE prior > current_position) AS heroes, count(*) FILTER (WHERE prior < current_position) AS villains FROM labelled WHERE is_fashion AND prior > 0 AND abs(prior - current_position) <= 30"


@query("d15_labels_today", _D15)
def d15(spark, folder):
    return D.labels_today(labelled(spark, folder))


_SORT = {"high-low": "current_position, id", "low-high": "current_position DESC, id", "volume": "visitors DESC, current_position, id"}
for _sort, _order in _SORT.items():

    @query(f"f{1 + (_sort == 'volume')}_sort_{_sort.replace('-', '_')}", f"SELECT p.id, current_position, visitors FROM products p JOIN (SELECT id, {_VISITORS} AS visitors FROM stores) s ON s.id = store_id WHERE is_fashion ORDER BY {_order} LIMIT 60")
    def f1(spark, folder, sort=_sort):
        stores, products, _ = tables(spark, folder)
        page = D.sort_limit(D.with_store(products.where(D.in_feed(True)), stores), sort, 60)
        return page.select("id", "current_position", X.visitors(F.col("monthly_visitors")).alias("visitors"))


def _feed(spark, folder, **parameters):
    stores, products, history, events = run_tables(spark, folder)
    return D.feed(stores, products, history, events, **({"sort": "high-low", "limit": 40} | FLOORS | parameters))


_LABEL_CARD = _CARD_SQL.format(p="p", label="label, change AS position_change, prior_position") + " FROM labels_now p JOIN stores s ON s.id = store_id WHERE {where} ORDER BY current_position, p.id LIMIT 40"
for _name, _fashion, _store in (("i1_combined_fashion_feed", True, None), ("i2_store_fashion_feed", True, 0), ("i3_combined_general_feed", False, None), ("i4_store_general_feed", False, 0)):
    _where = _FEED[_fashion] + (f" AND store_id = {_store}" if _store is not None else "")

    @query(_name, _LABEL_CARD.format(where=_where))
    def i_all(spark, folder, fashion=_fashion, store=_store):
        return _feed(spark, folder, is_fashion=fashion, label=None, store_id=store)

    @query(f"{_name}_new", _LABEL_CARD.format(where=_where + " AND label = 'new'"))
    def i_new(spark, folder, fashion=_fashion, store=_store):
        return _feed(spark, folder, is_fashion=fashion, label="new", store_id=store)

    if _store is None:

        @query(f"{_name}_heroes", "WITH " + _EVENTS.format(label="hero") + " " + _EVENT_CARD.format(active="true") + f" WHERE {_FEED[_fashion]} ORDER BY p.current_position, p.id LIMIT 40")
        def i_hero(spark, folder, fashion=_fashion):
            return _feed(spark, folder, is_fashion=fashion, label="hero")

    else:

        @query(f"{_name}_villains", _LABEL_CARD.format(where=_where + " AND label = 'villain'"))
        def i_villain(spark, folder, fashion=_fashion, store=_store):
            return _feed(spark, folder, is_fashion=fashion, label="villain", store_id=store)


@query("g16_searched_heroes", "WITH " + _EVENTS.format(label="hero") + " " + _EVENT_CARD.format(active="true") + f" WHERE {_FEED[False]} AND title LIKE '%widget%' ORDER BY p.current_position, p.id LIMIT 40")
def g16(spark, folder):
    hits = M.products(spark, folder).where(X.whole_word(F.col("title"), "widget")).select("id")
    return _feed(spark, folder, is_fashion=False, label="hero", matching=hits)


_MOVERS = "SELECT id, label, prior_position, current_position FROM labels_now WHERE label IN ('hero', 'villain') ORDER BY abs(change) DESC, id LIMIT 10"


@query("i5_movers_sample", _MOVERS)
def i5(spark, folder):
    movers = labelled(spark, folder).where("label IN ('hero', 'villain')")
    return movers.orderBy(F.abs("position_change").desc(), "id").limit(10).select("id", "label", "prior_position", "current_position")


_MEASURES = "SELECT '{section}' AS section, name, CAST(value AS BIGINT) AS value FROM (UNPIVOT ({sql}) ON COLUMNS(*) INTO NAME name VALUE value)"
_DAYS = f"SELECT * REPLACE (oldest - DATE '1970-01-01' AS oldest, newest - DATE '1970-01-01' AS newest) FROM ({_D7})"


@query("i5_movement_diagnostics", " UNION ALL ".join((
    f"SELECT 'snapshots' AS section, store_id || '/' || date AS name, snapshots AS value FROM ({_D5})",
    f"SELECT 'events', date || '/' || label, events FROM ({_D9})",
    *(_MEASURES.format(section=section, sql=sql) for section, sql in (("moves", _D6), ("ledger", _DAYS), ("today", _D15))),
    "SELECT 'movers', place || '/' || id, change FROM (SELECT id, change, row_number() OVER (ORDER BY abs(change) DESC, id) AS place FROM labels_now WHERE label IN ('hero', 'villain')) WHERE place <= 10",
)))
def i5_all(spark, folder):
    stores, products, history, events = run_tables(spark, folder)
    return D.movement_diagnostics(L.movement_labels(products, history, **FLOORS), stores, products, history, events, now=NOW, start="2024-01-10")
