"""Publishing: usable offers, ids, counters, groups by the first key that is set, nested prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.functions import text as tx
from offerloom.operators import dedup, merge, prices, publish, ranking
from offerloom.queries.tables import LAYERS, parts, sold
from offerloom.queries.views import LATEST, latest_offers, table


def published_offers(spark, d):
    p = table(spark, d, "part")
    rows = p.select(
        F.lit("").alias("merchant"), F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("name"), F.col("p_brand").alias("brand"), F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("price_eur"),
        F.when(F.col("p_size") > 5, F.col("p_retailprice") / 3).otherwise(F.lit(-1.0)).alias("price"), F.lit("").alias("image_url"), F.when(F.col("p_type") != "SMALL", F.concat(F.lit("i"), F.col("p_partkey"))).alias("image"),
        F.lit(None).cast("string").alias("source_url"), F.concat(F.lit("u"), F.col("p_partkey")).alias("url"),
    )
    return publish.published(rows, "shop")


def canonical_ids(spark, d):
    """Suppliers by name with dense ids."""
    return publish.with_ids(table(spark, d, "supplier").select("s_suppkey", "s_name"), "mega", ["s_name", "s_suppkey"])


def merge_counters(spark, d):
    """How many rows of a full merge were enriched, added, left."""
    rows = merge.layer(parts(spark, d), sold(spark, d), "p_partkey", {}, "full_outer")
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def tiered_key_groups(spark, d):
    """Orders grouped by the first key they have: a priority below the top of a customer, else the customer."""
    o = table(spark, d, "orders").withColumn("p", F.nullif("o_orderpriority", F.lit("1-URGENT")))
    key = dedup.tiered_key([["p", "o_custkey"], ["o_custkey"]])
    rows = o.groupBy(F.replace(key, F.lit("\x1f"), F.lit("|")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("min_price"))
    return rows


def category_shelves(spark, d):
    """Products per category, without one in the bucket of the unsorted."""
    slug = F.coalesce(F.nullif(F.replace(tx.fold("p_type"), F.lit(" "), F.lit("-")), F.lit("promo")), F.lit("non-classe"))
    return table(spark, d, "part").groupBy(slug.alias("category")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_product"))


def nested_price_filter(spark, d):
    """Prices inside an array, those above a bound taken out by a higher-order filter."""
    rows = prices.nested_export(latest_offers(spark, d), "product", "merchant", "price")
    low = F.filter("prices", lambda x: x.value < 2000)
    return rows.select("product", F.size("prices").cast("long").alias("n"), F.size(low).cast("long").alias("n_low"))


def latest_capture_per_url(spark, d):
    """The newest capture of each address with status 200; the first of equal times."""
    e = table(spark, d, "events").select(F.col("user_id").alias("url"), F.date_trunc("DAY", "ts").alias("ts"), "event_id", "event_type").filter("event_type <> 'error'")
    return ranking.first_per_key(e, ["url"], [F.desc("ts"), F.asc("event_id")])


def top_category_merchants(spark, d):
    """Distinct merchants and categories on offer."""
    rows = latest_offers(spark, d).join(table(spark, d, "part"), F.col("product") == F.col("p_partkey"))
    return rows.groupBy("p_type").agg(F.count_distinct("merchant").alias("n_merchants"), F.count_distinct("product").alias("n_products"))


QUERIES = {f.__name__: f for f in (published_offers, canonical_ids, merge_counters, tiered_key_groups, category_shelves, nested_price_filter, latest_capture_per_url, top_category_merchants)}

ORACLES = {
    "published_offers": """WITH r AS (SELECT 'shop' AS merchant, p_name AS name, p_brand AS brand, CASE WHEN p_size > 10 THEN p_retailprice WHEN p_size > 5 THEN p_retailprice / 3 ELSE -1 END AS price,
  CASE WHEN p_type <> 'SMALL' THEN 'i' || p_partkey END AS image_url, 'u' || p_partkey AS source_url FROM part)
SELECT merchant, name, brand, round(price, 2) AS price_eur, image_url, source_url FROM r WHERE price > 0 AND image_url IS NOT NULL""",
    "canonical_ids": "SELECT s_suppkey, s_name, 'mega-' || row_number() OVER (ORDER BY s_name, s_suppkey) AS id FROM supplier",
    "merge_counters": f"""WITH {LAYERS}
SELECT CASE WHEN b.p_partkey IS NULL THEN 'added' WHEN r.p_partkey IS NULL THEN 'base' ELSE 'enriched' END AS status, count(*) AS n FROM b FULL JOIN r ON b.p_partkey = r.p_partkey GROUP BY 1""",
    "tiered_key_groups": """SELECT CASE WHEN o_orderpriority <> '1-URGENT' THEN '1|' || o_orderpriority || '|' || o_custkey ELSE '2|' || o_custkey END AS key, count(*) AS n, min(o_totalprice) AS min_price FROM orders GROUP BY 1""",
    "category_shelves": "SELECT coalesce(nullif(lower(p_type), 'promo'), 'non-classe') AS category, count(*) AS n, min(p_partkey) AS first_product FROM part GROUP BY 1",
    "nested_price_filter": f"WITH {LATEST} SELECT product, count(*) AS n, count(*) FILTER (WHERE price < 2000) AS n_low FROM l GROUP BY product",
    "latest_capture_per_url": """WITH e AS (SELECT user_id AS url, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, event_id, event_type FROM events WHERE event_type <> 'error')
SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts DESC, event_id) = 1""",
    "top_category_merchants": f"WITH {LATEST} SELECT p_type, count(DISTINCT merchant) AS n_merchants, count(DISTINCT product) AS n_products FROM l JOIN part ON p_partkey = product GROUP BY p_type",
}
