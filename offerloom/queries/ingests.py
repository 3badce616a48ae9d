"""Two runs in a row of the whole ingests, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.operators import upserts
from offerloom.plans.lineage import cut, cut_alone
from offerloom.queries.views import table


def _days():
    return [F.to_timestamp(F.lit(f"2024-01-0{n} 00:00:00")) for n in (1, 2)]


def _batches(spark, d):
    """Line items of two halves of the orders as offers: a merchant's part under its reference, or without one under address and name.

    Every third part has no merchant reference, every fifth only its maker's; line items are in order.
    """
    item = table(spark, d, "lineitem").filter("l_partkey is not null")
    part, text = F.col("l_partkey"), lambda c: F.col(c).cast("string")
    rows = item.select(
        (F.col("l_orderkey").cast("long") * 10_000_000_000 + F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("seq"), F.concat(F.lit("  m"), text("l_suppkey"), F.lit(" ")).alias("merchant"),
        F.when(part % 3 != 0, F.concat(F.lit(" R"), text("l_partkey"))).otherwise(" ").alias("merchant_reference"), F.when(part % 5 == 0, F.concat(F.lit("F"), text("l_partkey"))).alias("manufacturer_reference"),
        F.lit("b").alias("brand"), F.when(part % 11 == 0, " ").otherwise(F.concat(F.lit("Part "), text("l_partkey"))).alias("name"), F.lit(None).cast("string").alias("variant"), F.concat(F.lit("u/"), text("l_partkey")).alias("source_url"),
        F.when(F.col("l_returnflag") != "A", F.col("l_quantity")).alias("price_eur"), F.when(F.col("l_linestatus") == "F", " dispo ").alias("availability"), F.col("l_orderkey"),
    )
    # of two line items with one number the larger price counts alone
    rows = rows.groupBy("seq", *[c for c in rows.columns if c not in ("seq", "price_eur", "availability")]).agg(F.max("price_eur").alias("price_eur"), F.max("availability").alias("availability"))
    return [rows.filter(F.col("l_orderkey") % 2 == n).drop("l_orderkey") for n in (0, 1)]


def _histories(spark, d, strict: bool = True):
    current, histories = spark.createDataFrame([], upserts.CURRENT), []
    for batch, at in zip(_batches(spark, d), _days()):
        done = upserts.daily_upsert(current, batch, at, "seed", strict)
        histories.append(done.history)
        current = cut(done.current, "current")
    return histories[0].unionByName(histories[1])


def _current(spark, d, strict: bool = True):
    """The current table after both runs; what a run writes on the way goes before the next one begins."""
    current = spark.createDataFrame([], upserts.CURRENT)
    for batch, at in zip(_batches(spark, d), _days()):
        current = cut_alone(lambda stored=current, batch=batch, at=at: upserts.daily_upsert(stored, batch, at, "seed", strict).current, "current")
    return current


_SHOWN = ("merchant", "merchant_reference", "manufacturer_reference", "name", "source_url")


def daily_upsert_current(spark, d):
    """The current table after two days: ids follow the first appearance."""
    return _current(spark, d).select("product_id", *_SHOWN, F.col("current_price_eur").alias("price_eur"), F.col("current_availability").alias("availability"), "first_seen_at", "last_seen_at")


def daily_upsert_history(spark, d):
    """Changes only, across both days."""
    return _histories(spark, d).groupBy("product_id", "observed_at").agg(F.count(F.lit(1)).alias("n"), F.sum("price_eur").alias("total"), F.count("availability").alias("n_available"))


def lenient_upsert_current(spark, d):
    """As the daily upsert, but names are not stripped and rows without one are kept."""
    return _current(spark, d, False).select("product_id", "merchant", "merchant_reference", "name", F.col("current_price_eur").alias("price_eur"), F.col("current_availability").alias("availability"), "last_seen_at")


def page_refresh(spark, d):
    """Seed rows refreshed from pages that lack some references; the rest is reported."""
    p = table(spark, d, "part")
    seed = p.select(F.concat(F.lit("u/"), F.col("p_partkey") % 7).alias("source_url"), F.concat(F.lit(" R"), F.col("p_partkey")).alias("merchant_reference"), F.lit("old").alias("manufacturer_reference"), F.lit(1.0).alias("price_eur"), F.lit("?").alias("availability"), "p_name")
    live = p.filter("p_size > 10").select(F.concat(F.lit("u/"), F.col("p_partkey") % 7).alias("source_url"), F.concat(F.lit("R"), F.col("p_partkey")).alias("merchant_reference"), F.when(F.col("p_size") > 30, "new").otherwise("").alias("manufacturer_reference"), F.col("p_retailprice").alias("price_eur"), F.lit("En stock").alias("availability"))
    done = upserts.refreshed(seed, live)
    return done.rows.withColumn("state", F.lit("refreshed")).unionByName(done.missing.withColumn("state", F.lit("missing")))


def _catalogue(spark, d):
    """Offers of two days. On the first, every product comes from one merchant; on the second from another, under an EAN, a reference
    written with signs, or neither and with a name that fits nothing."""
    p, text = table(spark, d, "part"), lambda c: F.col(c).cast("string")
    same = [F.lit(None).cast("string").alias(c) for c in ("brand", "category", "variant", "packaging", "image_url")]
    kind = F.col("p_partkey") % 4
    common = [F.lit("in_stock").alias("availability"), F.col("p_retailprice").alias("price"), F.lit("EUR").alias("currency")]
    ean, ref = F.when(kind == 0, F.lpad(text("p_partkey"), 13, "0")), F.when(kind == 1, F.concat(F.lit("QX"), F.lpad(text("p_partkey"), 8, "0")))
    first = p.select(F.col("p_partkey").alias("seq"), F.lit("m1").alias("merchant"), F.concat(F.lit("A"), text("p_partkey")).alias("merchant_reference"), F.concat(F.lit("a/"), text("p_partkey")).alias("url"), ref.alias("manufacturer_reference"), ean.alias("ean"), F.concat(F.lit("x"), F.sha1(text("p_partkey"))).alias("name"), *same, *common)
    ref2 = F.when(kind == 1, F.concat(F.lit("qx-"), F.lpad(text("p_partkey"), 8, "0"))).when(kind == 2, F.concat(F.lit("ZZ"), text("p_partkey")))
    second = p.select(F.col("p_partkey").alias("seq"), F.when(kind == 3, "m1").otherwise("m2").alias("merchant"), F.when(kind == 3, F.concat(F.lit("A"), text("p_partkey"))).alias("merchant_reference"), F.concat(F.lit("b/"), text("p_partkey")).alias("url"), ref2.alias("manufacturer_reference"), ean.alias("ean"), F.concat(F.lit("zz"), F.md5(text("p_partkey"))).alias("name"), *same, *common)
    mp, products, offers = spark.createDataFrame([], upserts.MERCHANT_PRODUCT), spark.createDataFrame([], upserts.PRODUCT), None
    for batch, at in zip((first, second), _days()):
        done = upserts.canonical_ingest(mp, products, batch, at)
        mp, products = cut(done.merchant_products, "merchant_products"), cut(done.products, "products")
        offers = done.offers if offers is None else offers.unionByName(done.offers)
    return mp, products, offers


def canonical_ingest_products(spark, d):
    """Merchant products with the canonical product that each leads to, by the merchant product that made it."""
    mp, _, _ = _catalogue(spark, d)
    made = mp.groupBy("product_id").agg(F.min_by("url", "id").alias("made_by"))
    return mp.join(made, "product_id").select("merchant", "merchant_reference", "url", "name", "manufacturer_reference", "ean", "made_by", "last_seen_at")


def canonical_ingest_offers(spark, d):
    """Offers per merchant and day, and how many canonical products there are."""
    mp, products, offers = _catalogue(spark, d)
    rows = offers.join(mp.select(F.col("id").alias("merchant_product_id"), "merchant", "product_id"), "merchant_product_id")
    out = rows.groupBy("merchant", "scraped_at").agg(F.count(F.lit(1)).alias("n_offers"), F.count_distinct("product_id").alias("n_products"))
    return out.join(F.broadcast(products.agg(F.count(F.lit(1)).alias("in_catalogue"))))  # one row


QUERIES = {f.__name__: f for f in (daily_upsert_current, daily_upsert_history, lenient_upsert_current, page_refresh, canonical_ingest_products, canonical_ingest_offers)}

_ROWS = """WITH r AS (SELECT CAST(l_orderkey AS BIGINT) * 10000000000 + CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS seq, l_suppkey, l_partkey, l_orderkey % 2 AS day, max(CASE WHEN l_returnflag <> 'A' THEN l_quantity END) AS price, max(CASE WHEN l_linestatus = 'F' THEN '{dispo}' END) AS stock
  FROM lineitem WHERE {kept} GROUP BY l_orderkey, l_linenumber, l_suppkey, l_partkey),
g AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY day, seq) AS turn, min(day) OVER (PARTITION BY l_suppkey, l_partkey) AS first_day, max(day) OVER (PARTITION BY l_suppkey, l_partkey) AS last_day,
  lag(price) OVER w AS p, lag(stock) OVER w AS a FROM r WINDOW w AS (PARTITION BY l_suppkey, l_partkey ORDER BY day, seq)),
i AS (SELECT l_suppkey, l_partkey, row_number() OVER (ORDER BY day, seq) AS product_id FROM g WHERE turn = 1),
l AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY day DESC, seq DESC) = 1)
"""
_STRICT, _LENIENT = _ROWS.format(dispo="dispo", kept="l_partkey % 11 <> 0"), _ROWS.format(dispo=" dispo ", kept="l_partkey IS NOT NULL")
_STAMP = "CASE {} WHEN 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-02' END"
ORACLES = {
    "daily_upsert_current": _STRICT + f"""SELECT product_id, 'm' || l_suppkey AS merchant, CASE WHEN l_partkey % 3 <> 0 THEN 'R' || l_partkey END AS merchant_reference, CASE WHEN l_partkey % 5 = 0 THEN 'F' || l_partkey END AS manufacturer_reference, 'Part ' || l_partkey AS name,
  'u/' || l_partkey AS source_url, price AS price_eur, stock AS availability, {_STAMP.format('first_day')} AS first_seen_at, {_STAMP.format('last_day')} AS last_seen_at FROM l JOIN i USING (l_suppkey, l_partkey)""",
    "daily_upsert_history": _STRICT + f"""SELECT product_id, {_STAMP.format('day')} AS observed_at, count(*) AS n, sum(price) AS total, count(stock) AS n_available FROM g JOIN i USING (l_suppkey, l_partkey)
WHERE turn = 1 OR price IS DISTINCT FROM p OR stock IS DISTINCT FROM a GROUP BY product_id, day""",
    "lenient_upsert_current": _LENIENT + f"""SELECT product_id, 'm' || l_suppkey AS merchant, CASE WHEN l_partkey % 3 <> 0 THEN 'R' || l_partkey END AS merchant_reference, CASE WHEN l_partkey % 11 = 0 THEN ' ' ELSE 'Part ' || l_partkey END AS name,
  price AS price_eur, stock AS availability, {_STAMP.format('last_day')} AS last_seen_at FROM l JOIN i USING (l_suppkey, l_partkey)""",
    "page_refresh": """SELECT 'u/' || p_partkey % 7 AS source_url, 'R' || p_partkey AS merchant_reference, CASE WHEN p_size > 30 THEN 'new' ELSE 'old' END AS manufacturer_reference, CASE WHEN p_size > 10 THEN p_retailprice ELSE 1.0 END AS price_eur,
  CASE WHEN p_size > 10 THEN 'En stock' ELSE '?' END AS availability, p_name, CASE WHEN p_size > 10 THEN 'refreshed' ELSE 'missing' END AS state FROM part""",
    "canonical_ingest_products": """WITH b AS (SELECT p_partkey AS k, p_partkey % 4 AS kind, CASE WHEN p_partkey % 4 = 0 THEN lpad(CAST(p_partkey AS VARCHAR), 13, '0') END AS ean, 'x' || sha1(CAST(p_partkey AS VARCHAR)) AS n1, 'zz' || md5(CAST(p_partkey AS VARCHAR)) AS n2 FROM part)
SELECT 'm1' AS merchant, 'A' || k AS merchant_reference, 'a/' || k AS url, CASE WHEN kind = 3 THEN n2 ELSE n1 END AS name, CASE WHEN kind = 1 THEN 'QX' || lpad(CAST(k AS VARCHAR), 8, '0') END AS manufacturer_reference, ean, 'a/' || k AS made_by,
  CASE WHEN kind = 3 THEN TIMESTAMP '2024-01-02' ELSE TIMESTAMP '2024-01-01' END AS last_seen_at FROM b
UNION ALL SELECT 'm2', NULL, 'b/' || k, n2, CASE kind WHEN 1 THEN 'QX' || lpad(CAST(k AS VARCHAR), 8, '0') WHEN 2 THEN 'ZZ' || k END, ean, CASE WHEN kind = 2 THEN 'b/' ELSE 'a/' END || k, TIMESTAMP '2024-01-02' FROM b WHERE kind <> 3""",
    "canonical_ingest_offers": """WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE p_partkey % 4 = 3) AS again, count(*) FILTER (WHERE p_partkey % 4 = 2) AS fresh FROM part)
SELECT 'm1' AS merchant, TIMESTAMP '2024-01-01' AS scraped_at, n AS n_offers, n AS n_products, n + fresh AS in_catalogue FROM c
UNION ALL SELECT 'm1', TIMESTAMP '2024-01-02', again, again, n + fresh FROM c UNION ALL SELECT 'm2', TIMESTAMP '2024-01-02', n - again, n - again, n + fresh FROM c""",
}
