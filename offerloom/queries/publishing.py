"""What happens to offers and addresses before they are published: completeness, permissions, seeds, queues, front-end fields, odd texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.functions import text as tx
from offerloom.operators import frontier, merge, publish
from offerloom.queries.views import table


def _text(c: str):
    return F.col(c).cast("string")


def completeness_split(spark, d):
    """Parts with a name, a price and an image, and the others with what they lack; empty texts count as missing."""
    p = table(spark, d, "part")
    rows = p.select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_name")).otherwise("").alias("name"), F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice").cast("string")).alias("price"), F.when(F.col("p_partkey") % 11 != 0, "i.png").otherwise("").alias("image"))
    whole, errors = publish.split_by_completeness(rows, ["name", "price", "image"])
    lacking = errors.select("p_partkey", F.array_join("lacking", ",").alias("lacking"), F.lit("incomplete_product").alias("kind"))
    return whole.select("p_partkey", F.lit(None).cast("string").alias("lacking"), F.lit("product").alias("kind")).unionByName(lacking)


def robots_permissions(spark, d):
    """Whether pages may be fetched under robots texts that are missing, empty, for all or for another agent."""
    rows = table(spark, d, "pages").select("page_id", "url", (F.col("page_id") % 4).alias("k"))
    told = F.when(F.col("k") == 1, "").when(F.col("k") == 2, "User-agent: *\nDisallow: /fr\nDisallow: /es").when(F.col("k") == 3, "User-agent: own\nDisallow: /\n\nUser-agent: *\nAllow: /")
    rows = rows.withColumn("robots", told)
    return rows.select("page_id", publish.robots_allow("robots", "url").alias("anyone"), publish.robots_allow("robots", "url", "own").alias("own"))


def category_seed_addresses(spark, d):
    """Category addresses of one host among the pages' paths: two parts deep or more, .html, without query."""
    rows = table(spark, d, "pages").select(F.concat(F.when(F.col("page_id") % 3 == 0, "https://other.example").otherwise("https://shop.example"), F.when(F.col("page_id") % 7 == 0, "/customer").otherwise(""), F.regexp_extract("url", "^[^:]*://[^/]*(.*)$", 1)).alias("url"))
    return publish.category_seeds(rows, "url", "shop.example")


def queue_next_pages(spark, d):
    """The next 60 pending pages of a queue, those of the least depth first, then by address."""
    queue = table(spark, d, "events").select(F.concat(F.lit("u/"), F.lpad(_text("event_id"), 9, "0")).alias("url"), (F.col("user_id") % 7).alias("depth"), F.when(F.col("event_type") == "view", "done").otherwise("pending").alias("status"))
    return frontier.next_pages(queue, 60).select("url", F.col("depth").cast("long").alias("depth"))


def schema_migration(spark, d):
    """A stored table of an older form in the columns of the present one."""
    wanted = {"p_partkey": "long", "ean": "string", "p_name": "string", "stock": "int"}
    return merge.add_missing_columns(table(spark, d, "part").select("p_name", "p_partkey", "p_size"), wanted)


def exact_cents(spark, d):
    """Prices that lie on or beside the middle of two cents, rounded by their exact value."""
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") / F.lit(200.0)).alias("a"), (F.col("o_totalprice") / F.lit(8.0)).alias("b"))
    return rows.select("o_orderkey", tx.valid_price(F.col("a")).alias("a"), tx.valid_price(F.col("b")).alias("b"))


def folds_of_odd_texts(spark, d):
    """Units, fractions, circled and wide characters beside part names: by compatibility forms, and by canonical ones as the front end does."""
    odd = F.concat(F.lit("10㎜ É"), "p_name", F.lit(" ⅓ ①Ａ ﬁn x²"))
    return table(spark, d, "part").select("p_partkey", tx.fold(odd).alias("folded"), tx.front_fold(odd).alias("front"), tx.ascii_key(odd).alias("key"))


def entities_of_texts(spark, d):
    """Entities of HTML 5, old ones without semicolon, numbers, and what is no entity."""
    odd = F.concat(F.lit("&check; caf&eacute &copyx &notin; "), "p_name", F.lit(" &#233;&#xE9;&#128; &unknown; & &amp;lt;"))
    return table(spark, d, "part").select("p_partkey", tx.unescape(odd).alias("text"))


def front_fields(spark, d):
    """Category key, label and detail, and the variants, as the front end makes them."""
    p = table(spark, d, "part")
    kinds = F.element_at(F.lit(["Anesthésie", "Prothèse", "Fraises", "Endodontie", "Désinfection", ""]), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = p.select("p_partkey", kinds.alias("detail"), F.concat("p_name", F.lit(" A3 "), _text("p_size"), F.lit(" mg N°25 ISO 30 xl XL")).alias("name"))
    field = publish.front_category(F.col("detail"), F.col("name"))
    return rows.select("p_partkey", field["key"].alias("category_key"), field["label"].alias("category_label"), field["detail"].alias("detail_category"), F.array_join(tx.front_variants("name"), ",").alias("variants"))


QUERIES = {f.__name__: f for f in (completeness_split, robots_permissions, category_seed_addresses, queue_next_pages, schema_migration, exact_cents, folds_of_odd_texts, entities_of_texts, front_fields)}

_PATH = "regexp_extract(url, '^[^:]*://[^/]*(.*)$', 1)"
ORACLES = {
    "completeness_split": """SELECT p_partkey, nullif(concat_ws(',', CASE WHEN p_size % 5 = 0 THEN 'name' END, CASE WHEN p_size % 7 = 0 THEN 'price' END, CASE WHEN p_partkey % 11 = 0 THEN 'image' END), '') AS lacking,
  CASE WHEN p_size % 5 = 0 OR p_size % 7 = 0 OR p_partkey % 11 = 0 THEN 'incomplete_product' ELSE 'product' END AS kind FROM part""",
    "robots_permissions": f"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN false WHEN 2 THEN NOT ({_PATH} LIKE '/fr%' OR {_PATH} LIKE '/es%') ELSE true END AS anyone,
  CASE page_id % 4 WHEN 0 THEN false WHEN 2 THEN NOT ({_PATH} LIKE '/fr%' OR {_PATH} LIKE '/es%') WHEN 3 THEN false ELSE true END AS own FROM pages""",
    "category_seed_addresses": f"""SELECT DISTINCT 'https://shop.example' || regexp_replace({_PATH}, '[?#].*$', '') AS url FROM pages
WHERE page_id % 3 <> 0 AND page_id % 7 <> 0 AND regexp_matches(regexp_replace({_PATH}, '[?#].*$', ''), '^/+[^/]+/.*[.]html$') AND NOT regexp_matches({_PATH}, '(?i)(customer|cart|checkout|login|search|contact)')""",
    "queue_next_pages": "SELECT 'u/' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS url, CAST(user_id % 7 AS BIGINT) AS depth FROM events WHERE event_type <> 'view' ORDER BY user_id % 7, event_id LIMIT 60",
    "schema_migration": "SELECT p_partkey, CAST(NULL AS VARCHAR) AS ean, p_name, CAST(NULL AS INTEGER) AS stock, p_size FROM part",
    "exact_cents": "SELECT o_orderkey, CASE WHEN o_orderkey > 0 THEN CAST(format('{:.2f}', o_orderkey / 200.0::DOUBLE) AS DOUBLE) END AS a, CASE WHEN o_totalprice > 0 THEN CAST(format('{:.2f}', o_totalprice / 8.0::DOUBLE) AS DOUBLE) END AS b FROM orders",
    "folds_of_odd_texts": "SELECT p_partkey, '10mm e' || p_name || ' 1 3 1a fin x2' AS folded, '10 e' || p_name || ' n x' AS front, '10mm e' || p_name || ' 13 1a fin x2' AS key FROM part",
    "entities_of_texts": "SELECT p_partkey, '✓ café ©x ∉ ' || p_name || ' éé€ &unknown; & &lt;' AS text FROM part",
    "front_fields": """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'anesthesie' WHEN 1 THEN 'empreintes' WHEN 2 THEN 'rotatifs' WHEN 3 THEN 'endodontie' WHEN 4 THEN 'hygiene' ELSE 'usage-unique' END AS category_key,
  CASE p_partkey % 6 WHEN 0 THEN 'Anesthésie' WHEN 1 THEN 'Empreintes' WHEN 2 THEN 'Instruments rotatifs' WHEN 3 THEN 'Endodontie' WHEN 4 THEN 'Hygiène & stérilisation' ELSE 'Usage unique' END AS category_label,
  CASE p_partkey % 6 WHEN 0 THEN 'Anesthésie' WHEN 1 THEN 'Prothèse' WHEN 2 THEN 'Fraises' WHEN 3 THEN 'Endodontie' WHEN 4 THEN 'Désinfection' ELSE '' END AS detail_category, 'A3,' || p_size || ' MG,XL' AS variants FROM part""",
}
