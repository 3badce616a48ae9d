"""Files written from the driver's tables and read back, and streams over such files.

The SQL says from the tables what must come back. Files lie in the cluster's shared folder.
"""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from offerloom.operators import frontier
from offerloom.plans.lineage import scratch
from offerloom.queries.views import latest_offers, table
from offerloom.sources import readers, writers
from offerloom.streaming import ingest, state


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _lines(df: DataFrame, value: Column, path: str) -> None:
    df.select(value.alias("value")).write.mode("append").text(path)


def _seed(spark, d):
    p = table(spark, d, "part")
    return p.select(
        F.lit("shop").alias("merchant"), F.col("p_brand").alias("brand"), F.concat(F.lit('say "'), F.col("p_name"), F.lit('", é')).alias("name"), F.lpad(_text("p_partkey"), 8, "0").alias("merchant_reference"), F.lit(None).cast("string").alias("manufacturer_reference"),
        F.lit(None).cast("string").alias("variant"), F.concat(_text("p_size"), F.lit(",5")).alias("price_eur"), F.lit("En stock").alias("availability"), F.concat(F.lit("u/"), _text("p_size")).alias("source_url"),
    )


def seed_csv_round_trip(spark, d):
    """A seed list as CSV with a byte-order mark: references keep their zeros, quotes and accents come back, prices have a comma."""
    path = scratch(spark, "seed")
    writers.csv(_seed(spark, d), path, mark=True)
    return readers.seed_csv(spark, path).select("merchant", "brand", "name", "merchant_reference", "price_eur", "source_url")


def seed_addresses(spark, d):
    path = scratch(spark, "seed")
    writers.json_and_csv(_seed(spark, d), path)
    return readers.seed_addresses(readers.seed_csv(spark, f"{path}/csv"))


def capture_round_trip(spark, d):
    """Capture files of every shape in one folder tree: objects with products, items or offers, lists of offers, compressed ones, a broken one."""
    path, p = scratch(spark, "captures"), table(spark, d, "part")
    offer = F.to_json(F.struct(F.col("p_name").alias("name"), F.lpad(_text("p_partkey"), 8, "0").alias("merchant_reference"), F.concat(_text("p_size"), F.lit(",5")).alias("price_eur"), F.when(F.col("p_partkey") % 3 == 0, "own").alias("merchant"), F.concat(F.lit("u/"), _text("p_partkey")).alias("url")))
    head = '{"merchant":"head","captured_at":"2024-01-01","%s":['
    for kind, (before, after) in enumerate(((head % "products", "]}"), (head % "items", "]}"), (head % "offers", "]}"), ("[", "]"))):
        rows = p.filter(F.col("p_partkey") % 4 == kind).groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list(offer)), ",").alias("offers"))
        # a file per brand, as a capture has one
        rows = rows.select("p_brand", F.concat(F.lit(before), "offers", F.lit(after)).alias("value"))
        rows.withColumn("brand", F.translate("p_brand", "#", "_")).drop("p_brand").repartition(8, "brand").write.partitionBy("brand").option("compression", "gzip" if kind == 1 else "none").text(f"{path}/{kind}")
    spark.range(1).select(F.lit('{"products": [broken').alias("value")).write.text(f"{path}/broken")
    return readers.captures(spark, f"{path}").select("name", "merchant_reference", "price_eur", "merchant", "source_url", "captured_at")


def checkpoint_round_trip(spark, d):
    """A checkpoint of JSON lines with broken lines, turned into the final catalogue: the last line of an address wins."""
    path, e = scratch(spark, "checkpoint"), table(spark, d, "events")
    rows = e.select("event_id", F.concat(F.lit("u/"), _text("user_id")).alias("source_url"), "value")
    for day in (0, 1):
        writers.json_lines(rows.filter(F.col("event_id") % 2 == day).coalesce(1).sortWithinPartitions("event_id"), f"{path}/{day}", append=True)
    _lines(rows.filter("event_id % 50 = 0"), F.concat(F.lit('{"event_id": '), _text("event_id")), f"{path}/2")
    done = readers.json_lines(spark, f"{path}/[0-2]", "event_id long, source_url string, value double", "source_url")
    writers.json_lines(done, f"{path}/final")
    return spark.read.schema(done.schema).json(f"{path}/final").unionByName(readers.json_or_empty(spark, f"{path}/missing", done.schema))


def url_list_round_trip(spark, d):
    """Distinct addresses of a host in order, without comments; the first 200 of them."""
    path, p = scratch(spark, "urls"), table(spark, d, "part")
    writers.url_list(p.withColumn("u", F.concat(F.lit("https://www.shop.example/"), F.col("p_size"))), "u", f"{path}/a")
    writers.url_list(p.withColumn("u", F.concat(F.lit("# https://www.shop.example/no"), F.col("p_size"))), "u", f"{path}/b")
    writers.url_list(p.withColumn("u", F.concat(F.lit("https://other.example/"), F.col("p_size"))), "u", f"{path}/c")
    return readers.url_list(spark, f"{path}/*", "shop.example").orderBy("url").limit(200)


def _sitemap(spark, d, path: str) -> None:
    p = table(spark, d, "part")
    url = F.concat(F.lit("<url><loc> https://www.shop.example/p/"), _text("p_partkey"), F.when(F.col("p_size") > 40, "/").otherwise(".html"), F.lit(" </loc>"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<priority>0."), F.col("p_size") % 10, F.lit("</priority>"))).otherwise(""), F.lit("</url>"))
    urls = p.groupBy("p_brand").agg(F.array_join(F.collect_list(url), "").alias("urls"))
    body = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "urls", F.lit("</urlset>"))
    # a file per brand
    urls.select(body.alias("value"), F.translate("p_brand", "#", "_").alias("brand")).repartition(8, "brand").write.partitionBy("brand").text(path)


def sitemap_round_trip(spark, d):
    path = scratch(spark, "sitemap")
    _sitemap(spark, d, path)
    return readers.sitemap(spark, path, "shop.example", 0.5, pages_only=True).select("loc", "priority")


def sitemap_index_tree(spark, d):
    """An index of indexes of sitemaps, a file per brand; one of them is not captured, one is not named."""
    p, site = table(spark, d, "part"), "https://www.shop.example"
    slug = F.translate("p_brand", "#", "-")
    leaf = p.groupBy("p_brand").agg(F.array_join(F.collect_list(F.concat(F.lit(f"<url><loc>{site}/p/"), _text("p_partkey"), F.lit("?a=1&amp;b=2</loc></url>"))), "").alias("body")).select(F.concat(F.lit(f"{site}/s/"), slug, F.lit(".xml")).alias("url"), "body")
    named = p.select("p_brand").distinct().filter("p_brand <> 'Brand#1'").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit(f"<sitemap><loc>{site}/s/"), slug, F.lit(".xml</loc></sitemap>")))), "").alias("body"))
    middle = named.select(F.lit(f"{site}/middle.xml").alias("url"), "body")
    root = spark.range(1).select(F.lit(f"{site}/sitemap.xml").alias("url"), F.lit(f"<sitemap><loc>{site}/middle.xml</loc></sitemap><sitemap><loc>{site}/gone.xml</loc></sitemap>").alias("body"))
    return readers.sitemap_tree(leaf.unionByName(middle).unionByName(root), f"{site}/sitemap.xml")


def capture_index_round_trip(spark, d):
    path, e = scratch(spark, "index"), table(spark, d, "events")
    line = F.concat(F.lit("example,shop)/"), _text("user_id"), F.lit(" "), F.date_format("ts", "yyyyMMddHHmmss"), F.lit(' {"url":"https://shop.example/'), _text("user_id"), F.lit('","status":"200","filename":"w.gz","offset":"'), _text("event_id"), F.lit('","length":"7"}'))
    _lines(e, F.when(F.col("event_id") % 10 == 0, "broken line").otherwise(line), path)
    return readers.capture_index(spark, path).select("urlkey", "timestamp", "url", "offset", "length")


def block_index_round_trip(spark, d):
    path, e = scratch(spark, "blocks"), table(spark, d, "events")
    _lines(e, F.concat_ws("\t", F.concat(F.lit("k"), _text("user_id")), F.lit("2024"), F.lit("cdx-1.gz"), _text("event_id"), F.when(F.col("event_id") % 10 != 0, "99"), F.lit("1")), path)
    return readers.block_index(spark, path).select("surt", F.col("cdx_file").alias("file"), "offset", "length", "block_id")


@F.pandas_udf(T.BinaryType())
def _zipped(texts: pd.Series, charset: pd.Series) -> pd.Series:
    return pd.Series([gzip.compress(t.encode(c), mtime=0) for t, c in zip(texts, charset)])


def archived_records(spark, d):
    """Pages of an archive: compressed records in two character sets."""
    p = table(spark, d, "part")
    charset = F.when(F.col("p_partkey") % 2 == 0, "iso-8859-1").otherwise("utf-8")
    body = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\n\r\nHTTP/1.1 200 OK\r\nContent-Type: text/html; charset="), charset, F.lit("\r\n\r\n<h1>été "), F.col("p_name"), F.lit("</h1>"))
    records = p.select("p_partkey", _zipped(body, charset).alias("record"))
    return records.select("p_partkey", readers.record_page("record").alias("html"))


def run_partitions(spark, d):
    """Two runs of a snapshot as partitions, with their counts."""
    path, rows = scratch(spark, "runs"), latest_offers(spark, d).select("merchant", "product", "price")
    for run in (1, 2):
        writers.run_partition(rows.filter(F.col("product") % 2 == run - 1), f"{path}/runs", f"{path}/offers", run)
    counted = spark.read.parquet(f"{path}/offers").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("merchant").alias("n_merchants"))
    return spark.read.parquet(f"{path}/runs").join(counted, "run_id").select(F.col("run_id").cast("long").alias("run_id"), "item_count", "n_rows", "n_merchants")


def payload_round_trip(spark, d):
    path = scratch(spark, "payload")
    writers.payload(latest_offers(spark, d).select("merchant", "product", "price"), path, {"with_price": F.count("price")})
    products = spark.read.json(f"{path}/products").agg(F.count(F.lit(1)).alias("n_products"))
    return spark.read.json(f"{path}/head").select("count", "with_price").join(F.broadcast(products))  # one row


def script_export(spark, d):
    """A script for a page, read back as lines."""
    path = scratch(spark, "script")
    writers.script(table(spark, d, "nation").select("n_nationkey", "n_name"), "NATIONS", path)
    return spark.read.text(path).select(F.trim("value").alias("line"))


def newest_file(spark, d):
    """Of a region's nations as files, written one region after the other, the file written last, read back."""
    path, nations = scratch(spark, "newest"), table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    for r in sorted(r["n_regionkey"] for r in nations.select("n_regionkey").distinct().collect()):  # five
        nations.filter(F.col("n_regionkey") == r).coalesce(1).write.json(f"{path}/{r}")
    found = readers.newest_file(spark, f"{path}/*/part-*").first()["path"]
    return spark.read.schema("n_nationkey long, n_name string, n_regionkey long").json(found)


def incremental_ingest(spark, d):
    """A table of events by user that a stream goes on with, in two runs; its state is the last event of each user."""
    folder, events = scratch(spark, "ingest"), table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    part = lambda n: events.filter(F.col("event_id") % 4 == n)
    pages = state.pages_for(events.agg(F.approx_count_distinct("user_id")).first()[0])
    for n in (1, 2, 3):
        part(n).write.parquet(f"{folder}/in/{n}")
        if n > 1:
            stream = ingest.arriving(spark, f"{folder}/in/*", events.schema, 1)
            state.append_changes(state.changed_rows(stream, "user_id", "event_id", initial=part(0), pages=pages), f"{folder}/out", f"{folder}/done")
    return state.current_rows(spark, f"{folder}/done")


def change_stream(spark, d):
    """Events streamed in order in bounded batches, in three runs: only those whose type differs from the user's event before come out."""
    folder, events = scratch(spark, "changes"), table(spark, d, "events").select("event_id", "user_id", "event_type")
    edges = events.selectExpr("min(event_id) a", "max(event_id) b", "approx_count_distinct(user_id) users").first()
    for part in range(3):
        low, high = (edges.a + (edges.b + 1 - edges.a) * k // 3 for k in (part, part + 1))
        events.filter(F.col("event_id").between(low, high - 1)).coalesce(1).write.parquet(f"{folder}/in/{part}")
        stream = ingest.arriving(spark, f"{folder}/in/*", events.schema, 1)
        state.append_changes(state.changed_rows(stream, "user_id", "event_id", ["event_type"], pages=state.pages_for(edges.users)), f"{folder}/out", f"{folder}/done")
    return spark.read.parquet(f"{folder}/out").select("event_id", "user_id", "event_type")


def blocked_ingest(spark, d):
    """A run stops at the batch with a refused page and goes on there when the page has been fetched; what was done is not done again."""
    folder, pages = scratch(spark, "blocked"), table(spark, d, "events").select("event_id", "user_id", (F.col("event_id") * 0 + 200).cast("int").alias("status"))
    pages.filter("event_id % 2 = 0").coalesce(1).write.parquet(f"{folder}/in/0")
    stream = lambda: ingest.arriving(spark, f"{folder}/in/*", pages.schema, 1)
    each = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
    first = ingest.drain_until_blocked(stream(), f"{folder}/done", each, "status = 403")
    pages.filter("event_id % 2 = 1").withColumn("status", F.lit(403)).coalesce(1).write.parquet(f"{folder}/in/1")
    second = ingest.drain_until_blocked(stream(), f"{folder}/done", each, "status = 403")
    third = ingest.drain_until_blocked(stream(), f"{folder}/done", each, "status = 599")
    out = spark.read.parquet(f"{folder}/out").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_pages"))
    return out.select(F.col("status").cast("long").alias("status"), "n", "n_pages", F.lit(f"{first} {second} {third}").alias("blocked"))


def appended_lines(spark, d):
    """Lines appended by a stream in two runs; the done-set is what the lines name."""
    folder, events = scratch(spark, "lines"), table(spark, d, "events").select("event_id", "user_id")
    for part in (0, 1):
        events.filter(F.col("event_id") % 2 == part).write.parquet(f"{folder}/in/{part}")
        ingest.append_lines(ingest.arriving(spark, f"{folder}/in/*", events.schema, 2), f"{folder}/out", f"{folder}/done")
    return spark.read.schema("event_id long, user_id long").json(f"{folder}/out").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


def listing_jobs(spark, d):
    """Listing pages taken from the roots in turn, twice; after the first batch one root goes back to a page that was not done."""
    cursors = table(spark, d, "nation").select(F.col("n_name").alias("root"), F.col("n_nationkey").alias("place"), (F.col("n_nationkey") % 3).cast("int").alias("next_page"))
    jobs = frontier.next_jobs(cursors, 60, 4)
    after = frontier.advance(cursors, jobs, jobs.filter("not (page = 2 and length(root) > 8)"))
    return after.select("root", F.col("next_page").cast("long").alias("next_page"))


QUERIES = {f.__name__: f for f in (
    seed_csv_round_trip, seed_addresses, capture_round_trip, checkpoint_round_trip, url_list_round_trip, sitemap_round_trip, sitemap_index_tree, capture_index_round_trip, block_index_round_trip, archived_records,
    run_partitions, payload_round_trip, script_export, newest_file, incremental_ingest, change_stream, blocked_ingest, appended_lines, listing_jobs,
)}

_LATEST = "(SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL)"
ORACLES = {
    "seed_csv_round_trip": """SELECT 'shop' AS merchant, p_brand AS brand, 'say "' || p_name || '", é' AS name, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS merchant_reference, p_size + 0.5 AS price_eur, 'u/' || p_size AS source_url FROM part""",
    "seed_addresses": "SELECT 'u/' || p_size AS source_url, count(*) AS n_rows FROM part GROUP BY 1",
    "capture_round_trip": """SELECT p_name AS name, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS merchant_reference, p_size + 0.5 AS price_eur, CASE WHEN p_partkey % 3 = 0 THEN 'own' WHEN p_partkey % 4 < 3 THEN 'head' END AS merchant,
  'u/' || p_partkey AS source_url, CASE WHEN p_partkey % 4 < 3 THEN '2024-01-01' END AS captured_at FROM part""",
    "checkpoint_round_trip": """SELECT event_id, 'u/' || user_id AS source_url, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2 DESC, event_id DESC) = 1""",
    "url_list_round_trip": "SELECT DISTINCT 'https://www.shop.example/' || p_size AS url FROM part ORDER BY url LIMIT 200",
    "sitemap_round_trip": """SELECT 'https://www.shop.example/p/' || p_partkey || '.html' AS loc, CASE WHEN p_partkey % 2 = 0 THEN (p_size % 10) / 10 ELSE 0.5 END AS priority FROM part WHERE p_size <= 40 AND (p_partkey % 2 = 1 OR p_size % 10 >= 5)""",
    "sitemap_index_tree": "SELECT 'https://www.shop.example/p/' || p_partkey || '?a=1&b=2' AS url FROM part WHERE p_brand <> 'Brand#1'",
    "capture_index_round_trip": "SELECT 'example,shop)/' || user_id AS urlkey, strftime(ts, '%Y%m%d%H%M%S') AS timestamp, 'https://shop.example/' || user_id AS url, event_id AS offset, CAST(7 AS BIGINT) AS length FROM events WHERE event_id % 10 <> 0",
    "block_index_round_trip": "SELECT 'k' || user_id AS surt, 'cdx-1.gz' AS file, event_id AS offset, CAST(99 AS BIGINT) AS length, CAST(1 AS BIGINT) AS block_id FROM events WHERE event_id % 10 <> 0",
    "archived_records": "SELECT p_partkey, '<h1>été ' || p_name || '</h1>' AS html FROM part",
    "run_partitions": f"SELECT CAST(l_partkey % 2 + 1 AS BIGINT) AS run_id, count(*) AS item_count, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_merchants FROM {_LATEST} GROUP BY 1",
    "payload_round_trip": f"SELECT count(*) AS count, count(*) AS with_price, count(*) AS n_products FROM {_LATEST}",
    "script_export": """SELECT 'window.NATIONS=[' AS line UNION ALL SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"},' FROM nation UNION ALL SELECT '];'""",
    "newest_file": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation WHERE n_regionkey = (SELECT max(n_regionkey) FROM nation)",
    "incremental_ingest": "SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "change_stream": """SELECT event_id, user_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id)""",
    "blocked_ingest": "SELECT CAST(CASE WHEN event_id % 2 = 0 THEN 200 ELSE 403 END AS BIGINT) AS status, count(*) AS n, count(*) AS n_pages, 'False True False' AS blocked FROM events GROUP BY 1",
    "appended_lines": "SELECT user_id, count(*) AS n, min(event_id) AS first FROM events GROUP BY user_id",
    "listing_jobs": """WITH c AS (SELECT n_name AS root, n_nationkey AS place, CAST(n_nationkey % 3 AS BIGINT) AS start FROM nation),
j AS (SELECT root, start, CAST(p AS BIGINT) AS page FROM c, range(4) AS r(p) WHERE p >= start ORDER BY p - start, place LIMIT 60),
a AS (SELECT root, max(page) + 1 AS after, min(page) FILTER (WHERE page = 2 AND length(root) > 8) AS again FROM j GROUP BY root)
SELECT root, coalesce(again, after, start) AS next_page FROM c LEFT JOIN a USING (root)""",
}
