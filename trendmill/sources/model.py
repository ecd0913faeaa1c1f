"""The four-table model, derived from the star-schema tables.

Stores come from suppliers, products from parts, and rank snapshots from events:
in a store and quarter of a day, products rank by the summed value of their
events. ``PRELUDE`` is the same derivation in DuckDB's SQL.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sides import merged

TODAY, START, NOW = "2024-01-30", "2024-01-08", "2024-01-30 18:00:00"


@lru_cache(maxsize=8)
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


def new_folder(spark: SparkSession) -> str:
    """A fresh path in the cluster's shared folder; in a temporary one only in local mode without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_folder(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/state-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df``, written once to the shared folder and read from there wherever it is used."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """Small rows that become much work or very many, dealt evenly to all tasks; their files may have few splits."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stores(spark: SparkSession, folder: str) -> DataFrame:
    named = read(spark, folder, "supplier").join(read(spark, folder, "nation").selectExpr("n_nationkey AS s_nationkey", "n_name"), "s_nationkey")
    return named.selectExpr(
        "s_suppkey AS id", "s_name AS name", "concat('https://', lower(replace(s_name, '#', '-')), '.example') AS url",
        "CASE WHEN s_acctbal < 0 THEN 'n/a' WHEN s_acctbal > 5000 THEN concat(cast(floor(s_acctbal / 1000) AS INT), 'K') ELSE cast(cast(floor(s_acctbal) AS INT) AS STRING) END AS monthly_visitors",
        "CASE s_suppkey % 3 WHEN 0 THEN 'Fashion' WHEN 1 THEN 'General' ELSE 'Fashion & General' END AS niche", "n_name AS country",
    )


def _with_store(spark: SparkSession, folder: str) -> DataFrame:
    """Parts with their store: a tenth of the suppliers sell all parts."""
    part, supplier = read(spark, folder, "part"), read(spark, folder, "supplier")
    count = supplier.selectExpr("greatest(1, cast(floor(count(*) / 10) AS BIGINT)) AS n_stores")
    return part.crossJoin(count).selectExpr("*", "p_partkey % n_stores AS store_id")  # one row


def history(spark: SparkSession, folder: str) -> DataFrame:
    """``id, product_id, store_id, position, date``; snapshots at the quarters of each day."""
    events = read(spark, folder, "events").selectExpr("user_id AS p_partkey", "to_date(ts) AS dt", "cast(floor(hour(ts) / 6) AS INT) AS q", "value")
    own = events.join(merged(_with_store(spark, folder).select("p_partkey", "store_id")), "p_partkey")
    summed = own.groupBy("p_partkey", "store_id", "dt", "q").agg(F.sum(F.col("value").cast("decimal(12,2)")).alias("v"))
    return summed.selectExpr(
        "p_partkey * 1000 + datediff(dt, DATE'2024-01-01') * 4 + q AS id", "p_partkey AS product_id", "store_id",
        "5 * row_number() OVER (PARTITION BY store_id, dt, q ORDER BY v DESC, p_partkey) - 4 AS position",
        "cast(dt AS TIMESTAMP_NTZ) + make_dt_interval(0, q * 6) AS date",
    )


def products(spark: SparkSession, folder: str, vectors: bool = False) -> DataFrame:
    """Products; with ``vectors`` also their embeddings, which cost a join."""
    last = history(spark, folder).where(f"to_date(date) = DATE'{TODAY}'").selectExpr("product_id AS p_partkey", "date", "position").groupBy("p_partkey").agg(F.max_by("position", "date").alias("now_position"))
    ranked = _with_store(spark, folder).selectExpr("*", "row_number() OVER (PARTITION BY store_id ORDER BY p_retailprice DESC, p_partkey) AS price_rank")
    joined = ranked.join(last, "p_partkey", "left")
    if vectors:
        joined = joined.join(read(spark, folder, "embeddings").selectExpr("vec_id AS p_partkey", "embedding"), "p_partkey", "left")
    return joined.selectExpr(
        "p_partkey AS id", "store_id", "concat(replace(p_name, ' ', '-'), '-', p_partkey) AS handle",
        "concat(p_name, CASE p_partkey % 5 WHEN 0 THEN ' for men' WHEN 1 THEN ' for women' ELSE '' END) AS title",
        "p_type AS product_type", "p_brand AS vendor", "cast(cast(p_retailprice AS DECIMAL(12,2)) AS STRING) AS price",
        "concat('//cdn.example/', p_partkey, '/', replace(p_name, ' ', '_'), '.jpg?v=', p_size) AS image_url",
        "cast(coalesce(now_position, 100 + price_rank) AS INT) AS current_position",
        "(p_name LIKE '%ring' OR p_name LIKE '%rod') AS is_fashion",
        "CASE WHEN p_size % 10 = 0 THEN '' WHEN p_name LIKE '%ring' THEN 'jewelry' WHEN p_name LIKE '%rod' THEN 'fashion' WHEN p_name LIKE '%plate' THEN 'home' ELSE 'other' END AS subniche",
        "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat('img:type:', split_part(p_name, ' ', 2), ', img:color:', split_part(p_name, ' ', 1), ' || ', p_brand, ', ', lower(p_type)) END AS ai_tags",
        "CASE WHEN p_partkey % 7 = 0 THEN '' ELSE split_part(p_name, ' ', 2) END AS product_category",
        "cast(date_sub(DATE'2024-01-30', cast(p_partkey % 9 AS INT)) AS TIMESTAMP_NTZ) AS last_scraped",
        "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE cast(DATE'2024-01-20' AS TIMESTAMP_NTZ) END AS vision_classified_at",
        *["embedding"] * vectors,
    )


PRELUDE = f"""
stores AS (SELECT s_suppkey AS id, s_name AS name, 'https://' || lower(replace(s_name, '#', '-')) || '.example' AS url,
  CASE WHEN s_acctbal < 0 THEN 'n/a' WHEN s_acctbal > 5000 THEN CAST(floor(s_acctbal/1000) AS INT) || 'K' ELSE CAST(CAST(floor(s_acctbal) AS INT) AS VARCHAR) END AS monthly_visitors,
  CASE s_suppkey % 3 WHEN 0 THEN 'Fashion' WHEN 1 THEN 'General' ELSE 'Fashion & General' END AS niche, n_name AS country
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
ws AS (SELECT p.*, p_partkey % (SELECT greatest(1, count(*) // 10) FROM supplier) AS store_id FROM part p),
history AS (SELECT p_partkey * 1000 + datediff('day', DATE '2024-01-01', dt) * 4 + q AS id, p_partkey AS product_id, store_id,
  CAST(5 * row_number() OVER (PARTITION BY store_id, dt, q ORDER BY v DESC, p_partkey) - 4 AS INT) AS position, CAST(dt AS TIMESTAMP) + to_hours(CAST(q * 6 AS INT)) AS date
  FROM (SELECT p_partkey, store_id, CAST(ts AS DATE) AS dt, hour(ts) // 6 AS q, sum(CAST(value AS DECIMAL(12,2))) AS v
        FROM events JOIN ws ON user_id = p_partkey GROUP BY ALL)),
products AS (SELECT p_partkey AS id, store_id, replace(p_name, ' ', '-') || '-' || p_partkey AS handle,
  p_name || CASE p_partkey % 5 WHEN 0 THEN ' for men' WHEN 1 THEN ' for women' ELSE '' END AS title, p_type AS product_type, p_brand AS vendor,
  CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS price, '//cdn.example/' || p_partkey || '/' || replace(p_name, ' ', '_') || '.jpg?v=' || p_size AS image_url,
  CAST(coalesce(now_position, 100 + price_rank) AS INT) AS current_position, (p_name LIKE '%ring' OR p_name LIKE '%rod') AS is_fashion,
  CASE WHEN p_size % 10 = 0 THEN '' WHEN p_name LIKE '%ring' THEN 'jewelry' WHEN p_name LIKE '%rod' THEN 'fashion' WHEN p_name LIKE '%plate' THEN 'home' ELSE 'other' END AS subniche,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'img:type:' || split_part(p_name, ' ', 2) || ', img:color:' || split_part(p_name, ' ', 1) || ' || ' || p_brand || ', ' || lower(p_type) END AS ai_tags,
  CASE WHEN p_partkey % 7 = 0 THEN '' ELSE split_part(p_name, ' ', 2) END AS product_category,
  CAST(DATE '2024-01-30' - CAST(p_partkey % 9 AS INT) AS TIMESTAMP) AS last_scraped,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE TIMESTAMP '2024-01-20' END AS vision_classified_at, embedding
  FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY p_retailprice DESC, p_partkey) AS price_rank FROM ws)
  LEFT JOIN (SELECT product_id, arg_max(position, date) AS now_position FROM history WHERE CAST(date AS DATE) = DATE '{TODAY}' GROUP BY 1) ON product_id = p_partkey
  LEFT JOIN embeddings ON vec_id = p_partkey),
sizes AS (SELECT store_id, is_fashion, count(*) FILTER (WHERE is_fashion OR subniche <> '') AS size FROM products GROUP BY ALL),
prior AS (SELECT product_id, arg_max(position, (date, id)) AS prior FROM history WHERE CAST(date AS DATE) < DATE '{TODAY}' AND date >= DATE '{START}' GROUP BY 1),
labelled AS (SELECT p.*, coalesce(size, 0) AS size, prior,
  CASE WHEN coalesce(size, 0) <= 0 THEN 30 ELSE least(30, greatest(1, CAST(floor(0.3 * size) AS INT))) END AS threshold
  FROM products p LEFT JOIN sizes USING (store_id, is_fashion) LEFT JOIN prior ON product_id = id),
labels_now AS (SELECT *, CASE WHEN coalesce(prior, 0) = 0 THEN 'new' WHEN prior = current_position OR abs(prior - current_position) > threshold THEN 'normal'
    WHEN current_position < prior THEN 'hero' ELSE 'villain' END AS label,
  CASE WHEN coalesce(prior, 0) = 0 OR abs(prior - current_position) > threshold THEN 0 ELSE prior - current_position END AS change, coalesce(prior, 0) AS prior_position FROM labelled),
daily AS (SELECT product_id, CAST(date AS DATE) AS dt, arg_max(position, (date, id)) AS position FROM history WHERE CAST(date AS DATE) BETWEEN greatest(DATE '{START}', DATE '{TODAY}' - 30) AND DATE '{TODAY}' - 1 GROUP BY ALL),
steps AS (SELECT product_id, dt, position, lag(position) OVER (PARTITION BY product_id ORDER BY dt) AS before FROM daily),
ledger AS (
  SELECT l.store_id, s.product_id, s.dt AS date, CASE WHEN position < before THEN 'hero' ELSE 'villain' END AS label, before AS prior_position, position AS current_position, before - position AS position_change
  FROM steps s JOIN labelled l ON l.id = s.product_id WHERE before IS NOT NULL AND before <> 0 AND position <> 0 AND position <> before AND abs(before - position) <= threshold
  UNION ALL SELECT store_id, id, DATE '{TODAY}', label, prior_position, current_position, change FROM labels_now WHERE label IN ('hero', 'villain') AND current_position <> 0)
"""
