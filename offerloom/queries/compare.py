"""Latest offers, comparisons, statistics, baskets and pages of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from offerloom.functions import text as tx
from offerloom.operators import classify, prices, ranking, search
from offerloom.plans.lineage import scratch
from offerloom.queries.views import CENTS, ITEMS, LATEST, OBSERVATIONS, TIE, basket_items, cents, latest_offers, observations, table


def latest_offer_per_merchant_product(spark, d):
    """Every product of every merchant with its newest observation."""
    rows = latest_offers(spark, d).join(table(spark, d, "part"), F.col("product") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("merchant") == F.col("s_suppkey"))
    return rows.select("product", "p_name", "p_brand", "merchant", "s_name", "price", "availability", "scraped_at")


def product_comparison_export(spark, d):
    rows = prices.comparison(latest_offers(spark, d), "product", "merchant", "price")
    return rows.join(table(spark, d, "part").select(F.col("p_partkey").alias("product"), "p_name", "p_brand"), "product")


def nested_offer_export(spark, d):
    offers = latest_offers(spark, d).withColumn("image", F.when(F.col("merchant") % 3 == 0, F.concat(F.lit("i"), F.col("merchant"))).otherwise(""))
    rows = prices.nested_export(offers, "product", "merchant", "price", "image")
    listed = F.array_join(F.transform("prices", lambda x: x.merchant.cast("string")), ",")
    return rows.select("product", F.size("prices").cast("long").alias("n_offers"), listed.alias("merchants"), F.col("prices")[0]["value"].alias("first_price"), "image")


def latest_run_per_merchant(spark, d):
    runs = observations(spark, d).groupBy("merchant", F.year("scraped_at").cast("long").alias("run_id")).agg(F.max("scraped_at").alias("finished_at"), F.count(F.lit(1)).alias("item_count"))
    return ranking.latest_per_key(runs, ["merchant"], "finished_at", ["run_id"])


def price_median_savings(spark, d):
    return prices.median_savings(latest_offers(spark, d), "product", "price")


def top3_offers_per_product(spark, d):
    return ranking.ranked(latest_offers(spark, d), ["product"], "price", ["merchant"], 3).select("product", "merchant", "price", F.col("price_rank").cast("long").alias("price_rank"))


def offer_price_bars(spark, d):
    return prices.bar_widths(latest_offers(spark, d).select("product", "merchant", "price"), "product", "price").select("product", "merchant", F.round("bar_percent", 6).alias("bar_percent"))


def _baskets(spark, d):
    return basket_items(spark, d), latest_offers(spark, d).select("product", "merchant", "price"), "basket", "product", "merchant", "price", "qty"


def single_merchant_basket(spark, d):
    """Baskets that one merchant can fill, with its total."""
    return prices.full_baskets(*_baskets(spark, d)).select("basket", "merchant", "n_items", cents("total").alias("total"))


def partial_coverage_top5(spark, d):
    return prices.best_partial(*_baskets(spark, d), cents).select("basket", "merchant", "covered", "n_items", "total", F.col("place").cast("long").alias("place"))


def cheapest_split_basket(spark, d):
    rows = prices.cheapest_split(basket_items(spark, d), latest_offers(spark, d).select("product", "merchant", "price"), "basket", "product", "merchant", "price", "qty")
    return rows.select("basket", "merchant", "n_items", cents("subtotal").alias("subtotal"))


def basket_quantities(spark, d):
    return basket_items(spark, d).groupBy("basket").agg(F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("n_items"))


def cheapest_split_total(spark, d):
    """What all of a basket costs at the cheapest merchant of each item, and at how many merchants."""
    rows = prices.cheapest_split(basket_items(spark, d), latest_offers(spark, d).select("product", "merchant", "price"), "basket", "product", "merchant", "price", "qty")
    return prices.split_totals(rows, "basket").select("basket", "n_merchants", "n_items", cents("total").alias("total"))


def offer_savings(spark, d):
    rows = prices.offer_savings(latest_offers(spark, d).select("product", "merchant", "price"), "product", "price")
    return rows.select("product", "merchant", "saving_percent", F.round("bar_percent", 6).alias("bar_percent"))


def _cart_events(spark, d):
    """Events as clicks in carts of two items: errors remove, every fifth event sets a quantity that may be below one, the others add."""
    e, kind = table(spark, d, "events"), F.col("event_id") % 5
    action = F.when(F.col("event_type") == "error", "remove").when(kind == 0, "set").otherwise("add")
    return e.select("user_id", (F.col("event_id") % 2).alias("item"), "event_id", action.alias("action"), (F.col("event_id") % 4 - 1).alias("qty"))


def cart_state(spark, d):
    """Carts after all clicks: adding, setting and removing, in their order."""
    return prices.cart(_cart_events(spark, d), ["user_id", "item"], "action", "qty", "event_id")


def category_names(spark, d):
    """Distinct categories in the order of the language: accents and capitals count only between equal letters."""
    accented = F.when(F.col("p_type") == "ECONOMY", "Économie").when(F.col("p_type") == "SMALL", "eau").when(F.col("p_type") == "LARGE", "Œuvre").otherwise(F.lower("p_type"))
    rows = table(spark, d, "part").select(accented.alias("category")).distinct().withColumn("place", F.collate("category", "UNICODE_CI_AI"))
    return rows.orderBy("place", "category").select("category")


def search_with_filters(spark, d):
    """Search by words together with a category and a bound of quality."""
    hay = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    flags = classify.quality_flags({"missing_price": F.col("p_retailprice") > 1500, "small": F.col("p_size") < 5})
    return table(spark, d, "part").filter(hay.contains("ring") & (F.col("p_type") == "ECONOMY") & (F.size(flags) == 0)).select("p_partkey", "p_name")


def payload_counters(spark, d):
    """The head of an exported catalogue: its number of offers, with price, with stock, of merchants, and the newest capture."""
    rows = latest_offers(spark, d)
    return rows.agg(F.count(F.lit(1)).alias("count"), F.count("price").alias("with_price"), F.count_if(F.col("availability") == "A").alias("in_stock"), F.count_distinct("merchant").alias("merchants"), F.max("scraped_at").alias("captured_at"))


def keyword_search_page(spark, d):
    hay = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return ranking.page(table(spark, d, "part").filter(hay.contains("ring")), [F.asc("p_retailprice"), F.asc("p_partkey")], 60, 1).select("p_partkey", "p_name", "p_retailprice")


#: What is searched for: words, parts of words, two letters, one letter, several words, nothing that is there.
SEARCHED = ("ring", "ed W", "#1", "e", "small ring brand", "no such part")


def indexed_search(spark, d):
    """Parts found by an index of their names, brands and types, for each of several queries."""
    p, hay, path = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type"), F.concat_ws(" ", "p_name", "p_brand", "p_type"), scratch(spark, "grams")
    search.build(p, "p_partkey", hay, path, 16)
    found = [search.search(p, "p_partkey", hay, path, q).select(F.lit(q).alias("query"), "p_partkey", "p_name") for q in SEARCHED]
    return reduce(DataFrame.unionByName, found)


def nulls_first_listing(spark, d):
    """Products by availability of a size, unknown first, then by folded name."""
    rows = table(spark, d, "part").select("p_partkey", F.nullif("p_size", F.lit(11)).alias("size"), F.lower("p_name").alias("name"))
    return rows.orderBy(F.asc_nulls_first("size"), "name", "p_partkey")


def range_scan_with_predecessor(spark, d):
    rows = table(spark, d, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("surt"), "o_totalprice")
    return ranking.key_range(rows, "surt", "0000000500", "0000000560", 40)


def status_counts(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.groupBy(F.concat_ws(":", "l_returnflag", "l_linestatus").alias("state")).agg(F.count(F.lit(1)).alias("n"))


def category_histogram(spark, d):
    rows = table(spark, d, "part").withColumn("category", F.split_part("p_name", F.lit(" "), F.lit(2)))
    return classify.histogram(rows, "category", "p_partkey")


def completeness_report(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.when(F.col("value") > 5, F.col("value")).alias("price"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("brand"), F.get_json_object("props", "$.k").alias("image"), F.lit("").alias("category"))
    return classify.completeness_report(rows, ["price", "brand", "image", "category"])


def active_merchants(spark, d):
    """Distinct merchants with a finished run, by name."""
    sold = table(spark, d, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    return table(spark, d, "supplier").join(sold, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


def filtered_offer_total(spark, d):
    """Groups and offers of a category, as the head of a result page says."""
    rows = latest_offers(spark, d).groupBy("product").agg(F.count(F.lit(1)).alias("n")).join(table(spark, d, "part"), F.col("product") == F.col("p_partkey")).filter("p_type = 'ECONOMY'")
    return rows.agg(F.count(F.lit(1)).alias("n_products"), F.sum("n").alias("n_offers"))


def price_display(spark, d):
    return table(spark, d, "orders").select("o_orderkey", tx.money("o_totalprice").alias("shown"), tx.js_round(F.col("o_totalprice") / 1000).cast("long").alias("thousands"))


QUERIES = {f.__name__: f for f in (
    latest_offer_per_merchant_product, product_comparison_export, nested_offer_export, latest_run_per_merchant, price_median_savings, top3_offers_per_product,
    offer_price_bars, single_merchant_basket, partial_coverage_top5, cheapest_split_basket, cheapest_split_total, offer_savings, category_names, search_with_filters, payload_counters, basket_quantities, cart_state, keyword_search_page, indexed_search,
    nulls_first_listing, range_scan_with_predecessor, status_counts, category_histogram, completeness_report, active_merchants, filtered_offer_total, price_display,
)}

_BASKETS = f"""WITH {LATEST}, {ITEMS},
n AS (SELECT basket, count(*) AS n_items FROM i GROUP BY basket),
c AS (SELECT i.basket, l.merchant, count(DISTINCT i.product) AS covered, {CENTS.format("sum(l.price * i.qty)")} AS total FROM i JOIN l USING (product) GROUP BY ALL)
"""
ORACLES = {
    "latest_offer_per_merchant_product": f"""WITH {LATEST}
SELECT s.product, p_name, p_brand, s.merchant, s_name, price, availability, scraped_at
FROM (SELECT DISTINCT merchant, product FROM o) s JOIN part ON p_partkey = s.product JOIN supplier ON s_suppkey = s.merchant
LEFT JOIN l ON l.merchant = s.merchant AND l.product = s.product""",
    "product_comparison_export": f"""WITH {LATEST}
SELECT product, p_name, p_brand, count(price) AS n_offers, min(price) AS min_price, max(price) AS max_price, first(merchant ORDER BY price, merchant) AS cheapest_merchant
FROM l JOIN part ON p_partkey = product GROUP BY ALL""",
    "nested_offer_export": f"""WITH {LATEST}
SELECT product, count(*) AS n_offers, string_agg(CAST(merchant AS VARCHAR), ',' ORDER BY price, merchant) AS merchants, min(price) AS first_price,
  first('i' || merchant ORDER BY merchant) FILTER (WHERE merchant % 3 = 0) AS image FROM l GROUP BY product""",
    "latest_run_per_merchant": f"""WITH {OBSERVATIONS},
r AS (SELECT merchant, CAST(year(scraped_at) AS BIGINT) AS run_id, max(scraped_at) AS finished_at, count(*) AS item_count FROM o GROUP BY ALL)
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY merchant ORDER BY finished_at DESC, run_id DESC) = 1""",
    "price_median_savings": f"""WITH {LATEST}, m AS (SELECT product, median(price) AS median_price, min(price) AS min_price FROM l GROUP BY product)
SELECT *, CAST(CASE WHEN median_price > 0 THEN floor((median_price - min_price) / median_price * 100 + 0.5) ELSE 0 END AS BIGINT) AS saving_percent FROM m""",
    "top3_offers_per_product": f"""WITH {LATEST}
SELECT product, merchant, price, row_number() OVER (PARTITION BY product ORDER BY price, merchant) AS price_rank FROM l QUALIFY price_rank <= 3""",
    "offer_price_bars": f"""WITH {LATEST}
SELECT product, merchant, round(greatest(18.0, 100 * price / max(price) OVER (PARTITION BY product)), 6) AS bar_percent FROM l""",
    "single_merchant_basket": _BASKETS + "SELECT basket, merchant, n_items, total FROM c JOIN n USING (basket) WHERE covered = n_items",
    "partial_coverage_top5": _BASKETS + "SELECT basket, merchant, covered, n_items, total, row_number() OVER (PARTITION BY basket ORDER BY covered DESC, total, merchant) AS place FROM c JOIN n USING (basket) QUALIFY place <= 5",
    "cheapest_split_basket": f"""WITH {LATEST}, {ITEMS},
b AS (SELECT product, merchant, price FROM l QUALIFY row_number() OVER (PARTITION BY product ORDER BY price, merchant) = 1)
SELECT basket, merchant, count(*) AS n_items, {CENTS.format("sum(price * qty)")} AS subtotal FROM i JOIN b USING (product) GROUP BY ALL""",
    "basket_quantities": f"WITH {ITEMS} SELECT basket, sum(qty) AS qty, count(*) AS n_items FROM i GROUP BY basket",
    "cheapest_split_total": f"""WITH {LATEST}, {ITEMS},
b AS (SELECT product, merchant, price FROM l QUALIFY row_number() OVER (PARTITION BY product ORDER BY price, merchant) = 1)
SELECT basket, count(DISTINCT merchant) AS n_merchants, count(*) AS n_items, {CENTS.format("sum(price * qty)")} AS total FROM i JOIN b USING (product) GROUP BY basket""",
    "offer_savings": f"""WITH {LATEST}, m AS (SELECT *, median(price) OVER (PARTITION BY product) AS med, max(price) OVER (PARTITION BY product) AS top FROM l)
SELECT product, merchant, CAST(CASE WHEN med > 0 THEN floor((med - price) / med * 100 + 0.5) ELSE 0 END AS BIGINT) AS saving_percent, round(least(100.0, 100 * price / top), 6) AS bar_percent FROM m""",
    "category_names": """SELECT DISTINCT CASE p_type WHEN 'ECONOMY' THEN 'Économie' WHEN 'SMALL' THEN 'eau' WHEN 'LARGE' THEN 'Œuvre' ELSE lower(p_type) END AS category FROM part""",
    "search_with_filters": """SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'ring') AND p_type = 'ECONOMY' AND p_retailprice <= 1500 AND p_size >= 5""",
    "payload_counters": f"WITH {LATEST} SELECT count(*) AS count, count(price) AS with_price, count(*) FILTER (WHERE availability = 'A') AS in_stock, count(DISTINCT merchant) AS merchants, max(scraped_at) AS captured_at FROM l",
    "cart_state": """WITH RECURSIVE e AS (SELECT user_id, event_id % 2 AS item, event_type = 'error' AS gone, event_id % 5 = 0 AS placed, event_id % 4 - 1 AS qty, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) AS turn FROM events),
s AS (SELECT user_id, item, CAST(0 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS n FROM (SELECT DISTINCT user_id, item FROM e)
  UNION ALL SELECT s.user_id, s.item, e.turn, CASE WHEN e.gone THEN 0 WHEN e.placed THEN CASE WHEN s.n > 0 THEN greatest(1, e.qty) ELSE 0 END ELSE s.n + 1 END FROM s JOIN e ON e.user_id = s.user_id AND e.item = s.item AND e.turn = s.turn + 1)
SELECT user_id, item, n AS qty FROM s JOIN (SELECT user_id, item, max(turn) AS turn FROM e GROUP BY user_id, item) USING (user_id, item, turn) WHERE n > 0""",
    "indexed_search": " UNION ALL ".join(f"SELECT '{q}' AS query, p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), '{q.lower()}')" for q in SEARCHED),
    "keyword_search_page": """SELECT p_partkey, p_name, p_retailprice FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'ring')
ORDER BY p_retailprice, p_partkey LIMIT 60 OFFSET 60""",
    "nulls_first_listing": "SELECT p_partkey, nullif(p_size, 11) AS size, lower(p_name) AS name FROM part ORDER BY size NULLS FIRST, name, p_partkey",
    "range_scan_with_predecessor": """WITH b AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS surt, o_totalprice FROM orders)
SELECT * FROM b WHERE (surt >= '0000000500' AND surt < '0000000560') OR surt = (SELECT max(surt) FROM b WHERE surt < '0000000500') ORDER BY surt LIMIT 40""",
    "status_counts": "SELECT l_returnflag || ':' || l_linestatus AS state, count(*) AS n FROM lineitem GROUP BY 1",
    "category_histogram": "SELECT split_part(p_name, ' ', 2) AS category, count(*) AS n, min(p_partkey) AS first_seq FROM part GROUP BY 1",
    "completeness_report": """SELECT count(*) AS total, count(*) FILTER (WHERE value > 5) AS with_price, count(*) FILTER (WHERE event_type <> 'error') AS with_brand,
count(*) FILTER (WHERE json_extract_string(props, '$.k') <> '') AS with_image, CAST(0 AS BIGINT) AS with_category FROM events""",
    "active_merchants": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_linestatus = 'F')",
    "filtered_offer_total": f"""WITH {LATEST}, g AS (SELECT product, count(*) AS n FROM l JOIN part ON p_partkey = product WHERE p_type = 'ECONOMY' GROUP BY product)
SELECT count(*) AS n_products, CAST(sum(n) AS BIGINT) AS n_offers FROM g""",
    "price_display": """SELECT o_orderkey, replace(format('{:.2f}', o_totalprice), '.', ',') || ' €' AS shown, CAST(floor(o_totalprice / 1000 + 0.5) AS BIGINT) AS thousands FROM orders""",
}
