"""Deduplication, layered merges, upserts, lookups, change capture, frontiers and incremental ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.operators import classify, dedup, frontier, merge, ranking
from offerloom.queries.views import OBSERVATIONS, TIE, observations, table


def tiered_dedupe(spark, d):
    """Line items by order line if returned, else by supplier and part; the first of a key stays."""
    rows = table(spark, d, "lineitem").withColumn("ref", F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")))
    kept = dedup.tiered_dedup(rows, [["ref", "l_orderkey"], ["l_suppkey", "l_partkey"]], ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"])
    return kept.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate")


def first_wins_distinct(spark, d):
    return ranking.first_wins(table(spark, d, "part").select("p_name", "p_partkey", "p_brand"), ["p_name"], ["p_partkey"])


def last_wins_by_key(spark, d):
    """The last event of each user and type, at the place of the first."""
    rows = ranking.last_wins(table(spark, d, "events"), ["user_id", "event_type"], ["event_id"], keep_position=True)
    return rows.select("user_id", "event_type", "event_id", "value", F.col("position.event_id").alias("position"))


def richest_record_per_key(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("value") > 5, F.col("value")).alias("price"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("brand"))
    best = ranking.richest_per_key(rows, ["user_id"], ["price", "brand"], ["event_id"])
    return best.select("user_id", "event_id", F.col("richness").cast("long").alias("richness"), "price", "brand")


def sold(spark, d):
    """What line items say of a part: a layer over the parts."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"))
    rows = rows.agg(F.max("l_quantity").alias("p_retailprice"), F.when(F.max("l_returnflag") == "R", "").otherwise(F.max("l_returnflag")).alias("p_brand"), F.min("l_linestatus").alias("p_type"))
    more = spark.range(1).select(F.lit(-1).cast("long").alias("p_partkey"), F.lit(1.0).alias("p_retailprice"), F.lit("new").alias("p_brand"), F.lit("NEW").alias("p_type"))
    return rows.unionByName(more)


def parts(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") > 25, F.col("p_type")).alias("p_type"), "p_retailprice")
    return rows


def merge_override(spark, d):
    return merge.layer(parts(spark, d), sold(spark, d), "p_partkey", {"p_retailprice": "pin"}, "full_outer")


def merge_fill_only(spark, d):
    return merge.layer(parts(spark, d), sold(spark, d), "p_partkey", {"*": "fill"})


def merge_mixed_fallback_key(spark, d):
    """First orders of customers, enriched from their last ones: by order key, and for those not found by customer."""
    o = table(spark, d, "orders")
    base = o.select("o_orderkey", "o_custkey", "o_totalprice", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("o_orderdate"))
    base = ranking.first_wins(base, ["o_custkey"], ["o_orderkey"])
    richer = ranking.last_wins(o.select("o_orderkey", "o_custkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), "o_orderdate"), ["o_custkey"], ["o_orderkey"])
    return merge.layer_with_fallback(base, richer, "o_orderkey", "o_custkey", {"o_totalprice": "override", "o_orderdate": "fill"})


def keep_old_when_null(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("value") > 20, F.col("value")).alias("value"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("event_type"))
    stored = ranking.first_wins(e.filter("event_id < 1000"), ["user_id"], ["event_id"]).select("user_id", "value", "event_type")
    return merge.keep_old_when_null(stored, e.filter("event_id >= 1000"), "user_id", "event_id")


def upsert_change_history(spark, d):
    """Observations whose price or availability differs from the one before."""
    rows = merge.changes(observations(spark, d), ["merchant", "product"], ["scraped_at", *TIE], ["price", "availability"])
    return rows.select("merchant", "product", "price", "availability", "scraped_at")


def scd_current_state(spark, d):
    return merge.current_state(observations(spark, d), ["merchant", "product"], "scraped_at", TIE).select("merchant", "product", "price", "availability", "first_seen", "last_seen")


def _two_days(spark, d):
    """Orders as a current table, and a batch with some of them changed, some new."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    day = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    current = o.filter("o_orderstatus <> 'P'").drop("o_orderpriority").select("*", day.alias("first_seen_at"), day.alias("last_seen_at"))
    batch = o.filter("o_orderpriority <> '5-LOW'").withColumn("o_totalprice", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return merge.upsert(current, batch, "o_orderkey", ["o_totalprice", "o_orderstatus"], F.to_timestamp(F.lit("2024-01-02 00:00:00")))


def upsert_current(spark, d):
    return _two_days(spark, d)[0]


def upsert_history(spark, d):
    return _two_days(spark, d)[1]


def change_only_events(spark, d):
    return merge.changes(table(spark, d, "events").select("event_id", "user_id", "event_type"), ["user_id"], ["event_id"], ["event_type"])


def pending_anti_join(spark, d):
    return dedup.pending(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


def stored_semi_join(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left_semi")


def insert_or_ignore(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return dedup.insert_or_ignore(ranking.first_wins(e.filter("event_id < 300"), ["user_id", "event_type"], ["event_id"]), e.filter("event_id >= 300"), ["user_id", "event_type"], ["event_id"])


def tiered_lookup(spark, d):
    """Orders looked up among earlier ones: by customer and price, else by customer and priority, else by customer."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"), "o_orderstatus")
    stored = o.filter("o_orderkey < 5000")
    return merge.tiered_lookup(o.filter("o_orderkey >= 5000").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"), stored, [["o_orderpriority", "o_custkey"], ["o_orderstatus", "o_custkey"], ["o_custkey"]], "o_orderkey", "o_orderkey").select("o_orderkey", "found_id", F.col("found_tier").cast("long").alias("found_tier"))


def _kinds():
    return {"name_brand": F.concat_ws("|", "p_name", "p_brand"), "name_type_size": F.concat_ws("|", "p_name", "p_type", F.col("p_size").cast("string"))}


def duplicate_groups(spark, d):
    return dedup.duplicate_members(table(spark, d, "part"), _kinds(), "p_partkey")


def duplicate_flags(spark, d):
    """Quality flags of products, with those of the groups that they are in."""
    rows = table(spark, d, "part").withColumn("flags", classify.quality_flags({"missing_price": F.col("p_retailprice") > 1500}))
    return dedup.with_duplicate_flags(rows, _kinds(), "p_partkey", "flags").select("p_partkey", F.array_join("flags", ",").alias("flags"))


def union_of_sources(spark, d):
    """All addresses of two sources, distinct, and how many rows they had."""
    a = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"))
    b = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return a.unionByName(b).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def frontier_reach(spark, d):
    """Parts and suppliers reached from a part over line items, in at most three steps."""
    links = _links(spark, d)
    return frontier.reach(spark.range(1).select(F.lit("p0").alias("url")), links, 3).withColumn("depth", F.col("depth").cast("long"))


def _links(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    out = l.select(F.concat(F.lit("p"), F.col("l_partkey")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("target"))
    return out.unionByName(out.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct().unionByName(spark.range(1).select(F.lit("p0").alias("source"), F.lit("s1").alias("target")))


def queue_marks(spark, d):
    """A queue of (address, kind): the state of one kind leaves the other alone."""
    urls = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("url"), "o_orderstatus")
    queue = urls.withColumn("kind", F.lit("listing")).unionByName(urls.withColumn("kind", F.lit("product"))).withColumn("status", F.lit("pending"))
    done = urls.filter("o_orderstatus = 'F'").select("url", F.lit("listing").alias("kind"), F.lit("done").alias("status"))
    return frontier.mark(queue, done).select("url", "kind", "status")


QUERIES = {f.__name__: f for f in (
    tiered_dedupe, first_wins_distinct, last_wins_by_key, richest_record_per_key, merge_override, merge_fill_only, merge_mixed_fallback_key, keep_old_when_null,
    upsert_change_history, scd_current_state, upsert_current, upsert_history, change_only_events, pending_anti_join, stored_semi_join, insert_or_ignore,
    tiered_lookup, duplicate_groups, duplicate_flags, union_of_sources, frontier_reach, queue_marks,
)}

LAYERS = """b AS (SELECT p_partkey, p_brand, CASE WHEN p_size > 25 THEN p_type END AS p_type, p_retailprice FROM part),
r AS (SELECT l_partkey AS p_partkey, max(l_quantity) AS p_retailprice, CASE WHEN max(l_returnflag) = 'R' THEN '' ELSE max(l_returnflag) END AS p_brand, min(l_linestatus) AS p_type
      FROM lineitem GROUP BY 1 UNION ALL SELECT -1, 1.0, 'new', 'NEW')"""
_DAYS = """c AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'),
n AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders WHERE o_orderpriority <> '5-LOW')"""
ORACLES = {
    "tiered_dedupe": """WITH k AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN '1|' || l_linenumber || '|' || l_orderkey ELSE '2|' || l_suppkey || '|' || l_partkey END AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_shipdate FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_partkey) = 1""",
    "first_wins_distinct": "SELECT p_name, p_partkey, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1",
    "last_wins_by_key": """SELECT user_id, event_type, event_id, value, min(event_id) OVER (PARTITION BY user_id, event_type) AS position FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""",
    "richest_record_per_key": """WITH e AS (SELECT event_id, user_id, CASE WHEN value > 5 THEN value END AS price, CASE WHEN event_type <> 'view' THEN event_type END AS brand FROM events),
r AS (SELECT *, CAST((price IS NOT NULL)::INT + (brand IS NOT NULL)::INT AS BIGINT) AS richness FROM e)
SELECT user_id, event_id, richness, price, brand FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY richness DESC, event_id DESC) = 1""",
    "merge_override": f"""WITH {LAYERS}
SELECT coalesce(b.p_partkey, r.p_partkey) AS p_partkey,
  CASE WHEN b.p_partkey IS NULL THEN r.p_brand ELSE coalesce(nullif(r.p_brand, ''), b.p_brand) END AS p_brand,
  CASE WHEN b.p_partkey IS NULL THEN r.p_type ELSE coalesce(nullif(r.p_type, ''), b.p_type) END AS p_type,
  CASE WHEN b.p_partkey IS NULL THEN r.p_retailprice ELSE b.p_retailprice END AS p_retailprice,
  CASE WHEN b.p_partkey IS NULL THEN 'added' WHEN r.p_partkey IS NULL THEN 'base' ELSE 'enriched' END AS status
FROM b FULL JOIN r ON b.p_partkey = r.p_partkey""",
    "merge_fill_only": f"""WITH {LAYERS}
SELECT b.p_partkey, coalesce(nullif(b.p_brand, ''), nullif(r.p_brand, '')) AS p_brand, coalesce(nullif(b.p_type, ''), nullif(r.p_type, '')) AS p_type,
  coalesce(b.p_retailprice, r.p_retailprice) AS p_retailprice, CASE WHEN r.p_partkey IS NULL THEN 'base' ELSE 'enriched' END AS status
FROM b LEFT JOIN r ON b.p_partkey = r.p_partkey""",
    "merge_mixed_fallback_key": """WITH b AS (SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS o_orderdate FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
r AS (SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice, o_orderdate FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
SELECT b.o_orderkey, b.o_custkey, coalesce(f.o_totalprice, s.o_totalprice, b.o_totalprice) AS o_totalprice, coalesce(b.o_orderdate, f.o_orderdate, s.o_orderdate) AS o_orderdate,
  CASE WHEN f.o_orderkey IS NULL AND s.o_orderkey IS NULL THEN 'base' ELSE 'enriched' END AS status
FROM b LEFT JOIN r f ON b.o_orderkey = f.o_orderkey LEFT JOIN r s ON b.o_custkey = s.o_custkey AND f.o_orderkey IS NULL""",
    "keep_old_when_null": """WITH e AS (SELECT event_id, user_id, CASE WHEN value > 20 THEN value END AS value, CASE WHEN event_type <> 'view' THEN event_type END AS event_type FROM events),
s AS (SELECT user_id, value, event_type FROM e WHERE event_id < 1000 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1),
n AS (SELECT user_id, arg_max(value, event_id) FILTER (WHERE value IS NOT NULL) AS value, arg_max(event_type, event_id) FILTER (WHERE event_type IS NOT NULL) AS event_type
      FROM e WHERE event_id >= 1000 GROUP BY user_id)
SELECT coalesce(s.user_id, n.user_id) AS user_id, coalesce(n.value, s.value) AS value, coalesce(n.event_type, s.event_type) AS event_type FROM s FULL JOIN n ON s.user_id = n.user_id""",
    "upsert_change_history": f"""WITH {OBSERVATIONS},
w AS (SELECT *, row_number() OVER k AS rn, lag(price) OVER k AS p, lag(availability) OVER k AS a FROM o WINDOW k AS (PARTITION BY merchant, product ORDER BY scraped_at, l_orderkey, l_linenumber))
SELECT merchant, product, price, availability, scraped_at FROM w WHERE rn = 1 OR price IS DISTINCT FROM p OR availability IS DISTINCT FROM a""",
    "scd_current_state": f"""WITH {OBSERVATIONS}
SELECT merchant, product, price, availability, min(scraped_at) OVER (PARTITION BY merchant, product) AS first_seen, max(scraped_at) OVER (PARTITION BY merchant, product) AS last_seen
FROM o QUALIFY row_number() OVER (PARTITION BY merchant, product ORDER BY scraped_at DESC, l_orderkey DESC, l_linenumber DESC) = 1""",
    "upsert_current": f"""WITH {_DAYS}
SELECT coalesce(n.o_orderkey, c.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_totalprice ELSE c.o_totalprice END AS o_totalprice,
  CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_orderstatus ELSE c.o_orderstatus END AS o_orderstatus,
  CASE WHEN c.o_orderkey IS NULL THEN TIMESTAMP '2024-01-02' ELSE TIMESTAMP '2024-01-01' END AS first_seen_at,
  CASE WHEN n.o_orderkey IS NULL THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-02' END AS last_seen_at
FROM c FULL JOIN n ON c.o_orderkey = n.o_orderkey""",
    "upsert_history": f"""WITH {_DAYS}
SELECT n.o_orderkey, n.o_totalprice, n.o_orderstatus, TIMESTAMP '2024-01-02' AS captured_at FROM n LEFT JOIN c ON c.o_orderkey = n.o_orderkey
WHERE c.o_orderkey IS NULL OR c.o_totalprice IS DISTINCT FROM n.o_totalprice OR c.o_orderstatus IS DISTINCT FROM n.o_orderstatus""",
    "change_only_events": """SELECT event_id, user_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id)""",
    "pending_anti_join": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "stored_semi_join": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "insert_or_ignore": """WITH s AS (SELECT event_id, user_id, event_type FROM events WHERE event_id < 300 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1),
i AS (SELECT event_id, user_id, event_type FROM events WHERE event_id >= 300 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1)
SELECT * FROM s UNION ALL SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = i.user_id AND s.event_type = i.event_type)""",
    "tiered_lookup": """WITH o AS (SELECT o_orderkey, o_custkey, nullif(o_orderpriority, '5-LOW') AS p, o_orderstatus AS s FROM orders),
q AS (SELECT o_orderkey, (SELECT min(x.o_orderkey) FROM o x WHERE x.o_orderkey < 5000 AND x.p = o.p AND x.o_custkey = o.o_custkey) AS a,
  (SELECT min(x.o_orderkey) FROM o x WHERE x.o_orderkey < 5000 AND x.s = o.s AND x.o_custkey = o.o_custkey) AS b,
  (SELECT min(x.o_orderkey) FROM o x WHERE x.o_orderkey < 5000 AND x.o_custkey = o.o_custkey) AS c FROM o WHERE o_orderkey >= 5000)
SELECT o_orderkey, coalesce(a, b, c) AS found_id, CAST(CASE WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 WHEN c IS NOT NULL THEN 3 END AS BIGINT) AS found_tier FROM q""",
    "duplicate_groups": """WITH k AS (SELECT 'name_brand' AS kind, p_name || '|' || p_brand AS key, p_partkey AS member FROM part UNION ALL SELECT 'name_type_size', p_name || '|' || p_type || '|' || p_size, p_partkey FROM part)
SELECT kind, key, count(*) OVER (PARTITION BY kind, key) AS n, member FROM k QUALIFY n > 1""",
    "duplicate_flags": """SELECT p_partkey, concat_ws(',', CASE WHEN p_retailprice > 1500 THEN 'missing_price' END, CASE WHEN count(*) OVER (PARTITION BY p_name, p_brand) > 1 THEN 'duplicate_name_brand' END,
  CASE WHEN count(*) OVER (PARTITION BY p_name, p_type, p_size) > 1 THEN 'duplicate_name_type_size' END) AS flags FROM part""",
    "union_of_sources": "SELECT id, count(*) AS n FROM (SELECT l_partkey AS id FROM lineitem UNION ALL SELECT p_partkey FROM part) GROUP BY id",
    "frontier_reach": """WITH RECURSIVE o AS (SELECT DISTINCT 'p' || l_partkey AS source, 's' || l_suppkey AS target FROM lineitem),
e AS (SELECT * FROM o UNION SELECT target, source FROM o UNION SELECT 'p0', 's1'),
r AS (SELECT 'p0' AS url, 0 AS depth UNION SELECT e.target, r.depth + 1 FROM r JOIN e ON e.source = r.url WHERE r.depth < 3)
SELECT url, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY url""",
    "queue_marks": """SELECT CAST(o_orderkey AS VARCHAR) AS url, kind, CASE WHEN kind = 'listing' AND o_orderstatus = 'F' THEN 'done' ELSE 'pending' END AS status
FROM orders, (VALUES ('listing'), ('product')) AS k(kind)""",
}
