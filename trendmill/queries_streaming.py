"""Queries that run the streams to the end over the derived snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from .operators import rules as R
from .operators import state as S
from .queries import query
from .queries_state import _demote, _junk, _promote
from .sources import model as M
from .sources.model import START
from .streaming import increments as N
from .streaming import ingest as I


def weekly(spark, folder, run: Callable[[str], None]):
    """Snapshots arrive week by week as files of one folder, and ``run(path)`` works off what is new after each."""
    path = M.new_folder(spark)
    rows = M.saved(M.history(spark, folder).select("id", "product_id", "store_id", "position", F.col("date").cast("timestamp").alias("date")))
    for week in range(5):
        rows.where(F.floor((F.dayofmonth("date") - 1) / 7) == week).write.mode("append").parquet(f"{path}/in")
        run(path)
    return path, rows


def finished(spark, folder, make, closing=True):
    """All rows of a stream over the weekly files, if ``closing`` after the closing snapshots."""

    def run(path):
        stream = make(I.read_snapshots(spark, f"{path}/in"))
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return stream.schema

    path, rows = weekly(spark, folder, run)
    if closing:
        I.closing_snapshots(rows).write.mode("append").parquet(f"{path}/in")
    return spark.read.schema(run(path)).parquet(f"{path}/out")


RUNS = tuple(f"2024-01-{day:02} {hour:02}:00:00" for day in (8, 19, 30) for hour in (6, 18))
_FIRST = f"SELECT * REPLACE (0 AS current_position) FROM ({_promote('(' + _demote('(' + _junk('(SELECT * REPLACE (CASE WHEN is_fashion THEN CASE WHEN subniche IN (' + chr(39) + 'fashion' + chr(39) + ', ' + chr(39) + 'jewelry' + chr(39) + ') THEN subniche ELSE ' + chr(39) + 'fashion' + chr(39) + ' END WHEN subniche IN (' + chr(39) + 'home' + chr(39) + ', ' + chr(39) + 'other' + chr(39) + ') THEN subniche ELSE ' + chr(39) + 'other' + chr(39) + ' END AS subniche) FROM products)') + ')') + ')')})"
_RUNS = f"""runs AS (SELECT row_number() OVER (ORDER BY moment) AS k, moment, coalesce(lag(moment) OVER (ORDER BY moment), TIMESTAMP '1970-01-01') AS since FROM (SELECT unnest([{', '.join(f"TIMESTAMP '{r}'" for r in RUNS)}]) AS moment)),
 listed AS (SELECT k, moment, product_id, store_id, arg_max(position, (date, id)) AS position FROM history JOIN runs ON date > since AND date <= moment GROUP BY ALL)"""


def run_scrapes(spark, folder):
    """What the shops list at each of ``RUNS``: every product with snapshots since the run before, at its last place."""
    runs = spark.createDataFrame([(a, b) for a, b in zip(("1970-01-01 00:00:00", *RUNS), RUNS)], "since string, at string").select(*(F.col(c).cast("timestamp_ntz").alias(c) for c in ("since", "at")))
    rows = M.history(spark, folder).join(F.broadcast(runs), (F.col("date") > F.col("since")) & (F.col("date") <= F.col("at")))  # as many rows as there are runs
    last = rows.groupBy("product_id", "at").agg(F.max_by("position", F.struct("date", "id")).alias("place"))
    own = last.join(M.products(spark, folder), F.col("product_id") == F.col("id"))
    return own.select("store_id", *(c for c in S.OVERWRITTEN if c != "current_position"), F.col("place").alias("current_position"), F.col("at").cast("timestamp").alias("date"))


def first_products(spark, folder):
    """Products as the rules leave them, before any run."""
    p = M.products(spark, folder)
    clean = p.withColumns({"subniche": R.sane_subniche(F.col("is_fashion"), F.col("subniche")), "current_position": F.lit(0)})
    return S.sweep_promote(S.sweep_demote(S.sweep_junk(clean)))


def ingested(spark, folder):
    """Scrape files arrive in four steps, the second and third of which split a day, and are applied as they arrive."""
    path = M.new_folder(spark)
    scrapes = M.saved(run_scrapes(spark, folder))
    N.begin(spark, f"{path}/tables", M.saved(first_products(spark, folder)))
    for k, own in enumerate((RUNS[:3], RUNS[3:4], RUNS[4:5], RUNS[5:])):
        scrapes.where(F.date_format("date", "yyyy-MM-dd HH:mm:ss").isin(*own)).write.parquet(f"{path}/in/step={k}")
        stream = spark.readStream.schema(scrapes.schema).parquet(f"{path}/in/step=*")
        I.ingest(stream, N.apply_batches(f"{path}/tables", N.Rules(START, START, cap=1 << 30, guard=1 << 30)), f"{path}/checkpoint")
    return f"{path}/tables"


@query("l1_incremental_ingest", "WITH first AS (" + _FIRST + f"), {_RUNS}," + """ of_first AS (SELECT store_id, is_fashion, count(*) FILTER (WHERE is_fashion OR subniche <> '') AS size FROM first GROUP BY ALL),
 seen AS (SELECT t.k, t.moment, p.id, p.store_id, p.is_fashion, arg_max(l.position, l.k) AS cur, arg_max(l.position, l.k) FILTER (WHERE CAST(l.moment AS DATE) < CAST(t.moment AS DATE)) AS prior
   FROM (SELECT DISTINCT k, moment, store_id FROM listed) t JOIN first p USING (store_id) JOIN listed l ON l.product_id = p.id AND l.k <= t.k GROUP BY ALL),
 moved AS (SELECT seen.*, row_number() OVER (PARTITION BY id, CAST(moment AS DATE) ORDER BY k DESC) AS n FROM seen JOIN of_first USING (store_id, is_fashion)
   WHERE prior <> cur AND abs(prior - cur) <= CASE WHEN size <= 0 THEN 30 ELSE least(30, greatest(1, CAST(floor(0.3 * size) AS INT))) END AND CAST(moment AS DATE) > DATE '2024-01-08')
 SELECT store_id, id AS product_id, CAST(moment AS DATE) AS date, CASE WHEN cur < prior THEN 'hero' ELSE 'villain' END AS label, prior AS prior_position, cur AS current_position, prior - cur AS position_change FROM moved WHERE n = 1""")
def l1(spark, folder):
    """Each batch applies its runs to products, appends snapshots and events, and commits all of it at once."""
    return N.table_of(spark, ingested(spark, folder), "ledger")


@query("a8_runs_of_a_day", f"WITH {_RUNS} SELECT product_id, store_id, position, moment AS date, CAST(moment AS DATE) AS dt FROM listed")
def a8_runs(spark, folder):
    """Snapshots of every run, of the first store and of the others apart, one of them written twice; two runs share each day."""
    path = f"{M.new_folder(spark)}/history"
    first = first_products(spark, folder)
    taken = run_scrapes(spark, folder).join(first.select("store_id", "handle", "id"), ["store_id", "handle"])
    rows = M.saved(taken.select(F.col("id").alias("product_id"), "store_id", F.col("current_position").alias("position"), F.col("date").cast("timestamp_ntz").alias("date")))
    for k, run in enumerate((*RUNS, RUNS[0])):
        own = rows.where(F.date_format("date", "yyyy-MM-dd HH:mm:ss") == run)
        S.write_history(own.where("store_id = 0"), path, f"run-{k % len(RUNS)}-a")
        S.write_history(own.where("store_id <> 0"), path, f"run-{k % len(RUNS)}-b")
    return S.read_history(spark, path).withColumnRenamed("day", "dt").drop("run")


@query("l2_daily_last_position", "SELECT product_id, CAST(date AS DATE) AS date, arg_max(position, date) AS position FROM history GROUP BY ALL")
def l2(spark, folder):
    return finished(spark, folder, I.daily_last_stream)


@query("l3_movement_stream", "SELECT * FROM ledger WHERE date < DATE '2024-01-30'")
def l3(spark, folder):
    """Days close by the watermark; the last one, today's, stays open."""
    products = M.saved(M.products(spark, folder).select("id", "store_id", "is_fashion", "subniche"))
    before = spark.conf.get(I.STATE_STORE[0])
    spark.conf.set(*I.STATE_STORE)
    try:
        return finished(spark, folder, lambda stream: I.movement_stream(stream, products, start=START), closing=False)
    finally:
        spark.conf.set(I.STATE_STORE[0], before)


@query("a2_event_json_products", "SELECT id AS page_id, replace(s.name, '#', '-') || '.example' AS store_id, handle, title, CASE WHEN p.id % 3 = 0 THEN '' ELSE price END AS price, vendor, product_type, 'https:' || image_url AS image_url, 'https://' || replace(s.name, '#', '-') || '.example/products/' || handle AS product_url FROM products p JOIN (SELECT id AS sid, name FROM stores) s ON s.sid = p.store_id")
def a2(spark, folder):
    from .sources.pages import page_items

    pages = json_pages(spark, folder)
    return page_items(pages).select("page_id", "store_id", "handle", "title", "price", "vendor", "product_type", "image_url", "product_url")


def json_pages(spark, folder):
    """A collection page per product, with its event block as a shop would write it."""
    sold = M.products(spark, folder).join(M.stores(spark, folder).select(F.col("id").alias("store_id"), "name"), "store_id")
    p = M.spread(sold.select("id", "name", "price", "image_url", "title", "handle", "vendor", "product_type"))
    amount = F.when(F.col("id") % 3 != 0, F.col("price").cast("double"))
    variant = F.struct(F.struct(amount.alias("amount")).alias("price"), F.struct(F.col("image_url").alias("src")).alias("image"), F.struct(F.col("id").cast("string").alias("id"), "title", F.concat(F.lit("/products/"), "handle", F.lit("?v=1")).alias("url"), "vendor", F.col("product_type").alias("type")).alias("product"))
    payload = F.to_json(F.struct(F.struct(F.array(variant, variant).alias("productVariants")).alias("collection")))
    events = F.concat(F.lit('[["page_viewed",{}],["collection_viewed",'), payload, F.lit("]]"))
    quoted = F.replace(F.replace(events, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    base = F.concat(F.lit("https://"), F.replace("name", F.lit("#"), F.lit("-")), F.lit(".example"))
    return p.select(F.col("id").alias("page_id"), F.concat(base, F.lit("/collections/all")).alias("url"), F.concat(F.lit('<html><script>{"events":"'), quoted, F.lit('"}</script></html>')).alias("html"))


@query("a4_card_products", "SELECT p.id AS page_id, handle, title, regexp_extract(price, '[0-9]{1,3}[.,][0-9]{2}') AS price, 'https:' || image_url AS image_url FROM products p")
def a4(spark, folder):
    from .sources.pages import page_items

    return page_items(card_pages(spark, folder)).select("page_id", "handle", "title", "price", "image_url")


def card_pages(spark, folder):
    """A collection page per product, with its card and no events."""
    p = M.spread(M.products(spark, folder).select("id", "handle", "title", "price", "image_url"))
    html = F.concat(F.lit('<main><div class="grid"><div class="card"><a href="/products/'), "handle", F.lit('?v=1"><img data-src="'), "image_url", F.lit('" alt="x"></a><div class="info"><a href="/products/'), "handle", F.lit('"><span> '), "title", F.lit('</span></a><b class="price-badge">-20%</b><span class="price">'), "price", F.lit("</span></div></div></div></main>"))
    return p.select(F.col("id").alias("page_id"), F.lit("https://shop.example/collections/all").alias("url"), html.alias("html"))


@query("a4_cards_of_pages")
def a4_pages(spark, folder):
    """The given raw pages, whose links aren't those of a shop: any rooted link counts as a product's."""
    from .sources.pages import card_items

    return card_items(M.spread(M.read(spark, folder, "pages").select("page_id", "url", "html")), r"^/([^/?#]+)").select("page_id", "store_id", "slot", "handle", "title", "price", "image_url")
