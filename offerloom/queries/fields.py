"""Scalar normalisation, classification, matching and page extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom.functions import text as tx
from offerloom.operators import classify, extract, matching
from offerloom.queries.views import table


def _products(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


def normalize_reference(spark, d):
    return _products(spark, d).select("p_partkey", tx.normalize_reference(F.concat_ws(" - ", "p_name", "p_brand")).alias("reference"))


def price_parse(spark, d):
    """Prices written the French way, read back."""
    o = table(spark, d, "orders")
    written = F.concat(F.replace(F.replace(F.format_number("o_totalprice", 2), F.lit(","), F.lit(" ")), F.lit("."), F.lit(",")), F.lit(" €"))
    return o.select("o_orderkey", tx.parse_price(written).alias("price"), tx.valid_price(F.col("o_totalprice")).alias("valid"))


def fold_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.fold("text")).alias("folded_md5"))


def url_canonical(spark, d):
    return table(spark, d, "pages").select("page_id", tx.canonical_url("url").alias("key"), tx.page_url("url").alias("page_url"), tx.reference_from_url("url").alias("reference"))


def link_extraction(spark, d):
    return extract.links(table(spark, d, "pages"), "html", "page_id")


def page_profile(spark, d):
    return extract.profile(table(spark, d, "pages"), "html", "page_id")


def category_classifier(spark, d):
    rows = table(spark, d, "documents").select("doc_id", classify.category("text").alias("category"))
    return rows


def base_category_classifier(spark, d):
    rows = table(spark, d, "documents").select("doc_id", classify.by_pattern(tx.fold("text"), classify.BASE_RULES, classify.BASE_DEFAULT).alias("category"))
    return rows


def qc_flags(spark, d):
    flags = {
        "missing_price": F.col("p_retailprice") > 1500,
        "missing_brand": F.col("p_brand") == "Brand#1",
        "weak_matching_identifiers": (F.col("p_size") % 5 == 0) & (F.col("p_type") == "SMALL"),
        "destockage_review": tx.ascii_key("p_name").contains("red"),
    }
    return _products(spark, d).select("p_partkey", F.array_join(classify.quality_flags(flags), ",").alias("flags"))


def completeness_score(spark, d):
    rows = table(spark, d, "events").select("event_id", F.nullif("event_type", F.lit("view")).alias("a"), F.when(F.col("value") > 10, F.col("value")).alias("b"), F.lit("").alias("c"))
    return rows.select("event_id", tx.completeness("a", "b", "c").cast("long").alias("score"), tx.fingerprint(F.lit("shop"), "a", F.col("event_id").cast("string")).alias("fingerprint"))


def _offers_and_products(spark, d):
    p = table(spark, d, "part")
    ean = lambda seq: F.when(F.col("p_size") < 15, F.lpad(seq.cast("string"), 13, "3")).alias("ean")
    side = lambda name, ref: [F.concat(F.lit("MR"), F.col("p_partkey") % ref).alias("manufacturer_reference"), F.col("p_brand").alias("brand"), name.alias("name"), F.lit("").alias("variant"), F.lit("").alias("packaging")]
    stored = F.col("p_type").isin("ECONOMY", "STANDARD", "LARGE")
    products = p.filter(stored).select(F.col("p_partkey").alias("product_id"), ean(F.col("p_partkey")), *side(F.col("p_name"), 900))
    offers = p.filter(~stored).select(F.col("p_partkey").alias("offer_id"), ean(F.col("p_partkey") + 1), *side(F.concat_ws(" ", "p_name", "p_type"), 700))
    return offers, products


def strong_id_match(spark, d):
    return matching.strong_matches(*_offers_and_products(spark, d))


def scored_match(spark, d):
    """The best product of each offer by identifiers, else by names, brands and packagings."""
    return matching.scored_matches(*_offers_and_products(spark, d)).withColumn("score", F.round("score", 6)).drop("n_scored")


def _worded_offers_and_products(spark, d):
    """Every third part as a product, the others as offers of it, some without the last word; some have EANs, references or both."""
    rows = _named_offers(spark, d).drop("ean", "manufacturer_reference").join(table(spark, d, "part").select(F.col("p_partkey").alias("offer_id"), "p_size"), "offer_id")
    of = F.floor(F.col("offer_id") / 3)
    rows = rows.withColumns({"brand": F.concat(F.lit("Brand#"), of % 25), "variant": F.lit(""), "packaging": F.lit(""), "ean": F.when(F.col("p_size") < 8, F.lpad((F.col("offer_id") % 500).cast("string"), 13, "3"))})
    rows = rows.withColumn("manufacturer_reference", F.when(F.col("p_size").between(6, 15), F.concat(F.lit("mr-"), F.col("offer_id") % 700)))
    short = F.when(F.col("offer_id") % 2 == 0, F.regexp_replace("name", " [a-z]+$", "")).otherwise(F.col("name"))
    return rows.filter("offer_id % 3 <> 0").withColumn("name", short), rows.filter("offer_id % 3 = 0").withColumnRenamed("offer_id", "product_id")


def best_match_full(spark, d):
    """The best product of each offer where one is found for sure: by EAN, by reference, or by all words and the brand; else null."""
    found = matching.scored_matches(*_worded_offers_and_products(spark, d))
    sure = F.col("score") > 0.9
    return found.select("offer_id", F.when(sure, F.col("product_id")).alias("product_id"), F.when(sure, F.round("score", 6)).alias("score"), F.when(sure, F.col("decision")).alias("decision"))


def match_routes_full(spark, d):
    """What becomes of each offer where that is sure: strong identifiers and automatic scores reuse a product, all words with the brand go to review."""
    offers, products = _worded_offers_and_products(spark, d)
    scored = matching.scored_matches(offers, products)
    strong = matching.strong_matches(offers, products)
    routes = matching.route(offers, strong, scored).join(scored.select("offer_id", "score"), "offer_id", "left").join(strong.select("offer_id", "why"), "offer_id", "left")
    sure = F.col("why").isNotNull() | (F.col("score") > 0.9)
    return routes.select("offer_id", F.when(sure, F.col("action")).alias("action"), F.when(sure, F.col("product_id")).alias("product_id"), "why")


def match_routes(spark, d):
    """What becomes of each offer: reuse of a product, review, or a new product."""
    offers, products = _offers_and_products(spark, d)
    return matching.route(offers, matching.strong_matches(offers, products), matching.sure_matches(offers, products))


def _named_offers(spark, d):
    """Parts as offers of three merchants; three parts in a row are one product under the same words, with the part's type."""
    p, of = table(spark, d, "part"), F.floor(F.col("p_partkey") / 3)
    words = [F.concat(F.lit("n"), of), F.concat(F.lit("kk"), of % 97), F.concat(F.lit("zz"), of % 89), F.lower("p_type")]
    none = [F.lit("").alias(c) for c in ("manufacturer_reference", "ean")]
    return p.select(F.col("p_partkey").alias("offer_id"), F.concat(F.lit("m"), F.col("p_partkey") % 3).alias("merchant"), F.concat_ws(" ", *words).alias("name"), F.col("p_brand").alias("brand"), *none)


def token_overlap_pairs(spark, d):
    return matching.token_overlap_pairs(_named_offers(spark, d), 3)


def greedy_grouping(spark, d):
    """Groups of offers with at most one of each merchant; offers are taken merchant by merchant."""
    offers = _named_offers(spark, d).withColumn("seq", F.col("offer_id") % 3 * 1_000_000 + F.col("offer_id"))
    return matching.greedy_groups(offers, ["m0", "m1", "m2"])


def props_parse(spark, d):
    """A semi-structured column read with a schema, broken values as null."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


QUERIES = {f.__name__: f for f in (
    normalize_reference, price_parse, fold_text, url_canonical,
    link_extraction, page_profile, category_classifier, base_category_classifier, qc_flags, completeness_score, strong_id_match,
    scored_match, best_match_full, match_routes_full, match_routes, token_overlap_pairs, greedy_grouping, props_parse,
)}


def _ascii(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce({text}, ''))), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def _fold(text: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({text})), '[^a-z0-9]+', ' ', 'g'))"


def _first(rules, test) -> str:
    return "CASE " + " ".join(f"WHEN {test(words)} THEN '{label}'" for label, words in rules)


_CATEGORY = _first(classify.CATEGORY_RULES, lambda words: " OR ".join(f"contains(hay, '{w}')" for w in words)) + f" ELSE '{classify.OTHER}' END"
_BASE = _first(classify.BASE_RULES, lambda pattern: f"regexp_matches(hay, '{pattern}')") + f" ELSE '{classify.BASE_DEFAULT}' END"
_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_WORDED = """WITH r AS (
  SELECT p_partkey AS id, 'Brand#' || (p_partkey // 3 % 25) AS brand, CASE WHEN p_size < 8 THEN lpad(CAST(p_partkey % 500 AS VARCHAR), 13, '3') END AS ean,
         CASE WHEN p_size BETWEEN 6 AND 15 THEN 'MR' || p_partkey % 700 END AS ref,
         ['n' || p_partkey // 3, 'kk' || (p_partkey // 3 % 97), 'zz' || (p_partkey // 3 % 89)] || CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 2 = 0 THEN [] ELSE [lower(p_type)] END AS words
  FROM part),
p AS (SELECT * FROM r WHERE id % 3 = 0 ORDER BY id DESC LIMIT 3000),
s AS (
  SELECT o.id AS offer_id, p.id AS product_id,
         CASE WHEN o.ean IS NOT NULL AND p.ean IS NOT NULL THEN CASE WHEN o.ean = p.ean THEN 1.0 ELSE 0.0 END
              WHEN o.ref IS NOT NULL AND p.ref IS NOT NULL THEN CASE WHEN o.ref <> p.ref THEN 0.08 WHEN o.brand = p.brand THEN 0.99 ELSE 0.82 END
              WHEN o.brand = p.brand AND (list_has_all(p.words, o.words) OR list_has_all(o.words, p.words)) THEN 0.91 ELSE 0.0 END AS score
  FROM r o, p WHERE o.id % 3 <> 0),
b AS (SELECT offer_id, max_by(product_id, score * 1000000000 + product_id) AS product_id, max(score) AS score FROM s GROUP BY offer_id)"""
ORACLES = {
    "best_match_full": _WORDED + """
SELECT offer_id, CASE WHEN score > 0.9 THEN product_id END AS product_id, CASE WHEN score > 0.9 THEN CAST(score AS DOUBLE) END AS score,
       CASE WHEN score >= 0.93 THEN 'auto_match' WHEN score > 0.9 THEN 'review' END AS decision FROM b""",
    "match_routes_full": _WORDED + """,
e AS (SELECT ean, min(id) AS product_id FROM r WHERE id % 3 = 0 AND ean IS NOT NULL GROUP BY ean),
f AS (SELECT ref, min(id) AS product_id FROM r WHERE id % 3 = 0 AND ref IS NOT NULL GROUP BY ref HAVING count(*) = 1),
g AS (SELECT b.*, coalesce(e.product_id, f.product_id) AS strong, CASE WHEN e.product_id IS NOT NULL THEN 'ean' WHEN f.product_id IS NOT NULL THEN 'manufacturer_reference' END AS why
      FROM b JOIN r ON r.id = offer_id LEFT JOIN e ON e.ean = r.ean LEFT JOIN f ON f.ref = r.ref)
SELECT offer_id, CASE WHEN strong IS NOT NULL OR score >= 0.93 THEN 'reuse' WHEN score > 0.9 THEN 'review' END AS action, CASE WHEN strong IS NOT NULL OR score > 0.9 THEN coalesce(strong, product_id) END AS product_id, why FROM g""",
    "normalize_reference": "SELECT p_partkey, regexp_replace(upper(p_name || ' - ' || p_brand), '[^A-Z0-9]', '', 'g') AS reference FROM part",
    "price_parse": "SELECT o_orderkey, o_totalprice AS price, CASE WHEN o_totalprice > 0 THEN round(o_totalprice, 2) END AS valid FROM orders",
    "fold_text": f"SELECT doc_id, md5({_fold('text')}) AS folded_md5 FROM documents",
    "url_canonical": """SELECT page_id, lower(regexp_replace(url, '/+$', '')) AS key,
  regexp_extract(url, '^[a-z]+://[^?#]*') || CASE WHEN regexp_matches(url, '[?&]p=') THEN '?p=' || regexp_extract(url, '[?&]p=([^&#]*)', 1) ELSE '' END AS page_url,
  nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(?i)-([0-9]{2,5}-[0-9]{2,5})\\.html$', 1), '') AS reference FROM pages""",
    "link_extraction": """SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href=["'']([^"''#]+)', 1)) AS href FROM pages""",
    "page_profile": """SELECT page_id, CAST(length(html) AS BIGINT) AS n_chars, CAST(len(regexp_extract_all(html, '<a\\s')) AS BIGINT) AS n_links, CAST(len(regexp_extract_all(html, '<script')) AS BIGINT) AS n_scripts,
  CAST(len(regexp_extract_all(html, '[0-9]+[,.][0-9]{2}\\s*(€|EUR)')) AS BIGINT) AS n_prices, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title,
  lower(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1))) IN ('just a moment...', 'just a moment', 'checking your browser', 'attention required') AS challenged FROM pages""",
    "category_classifier": f"SELECT doc_id, {_CATEGORY} AS category FROM (SELECT doc_id, {_ascii('text')} AS hay FROM documents)",
    "base_category_classifier": f"SELECT doc_id, {_BASE} AS category FROM (SELECT doc_id, {_fold('text')} AS hay FROM documents)",
    "qc_flags": """SELECT p_partkey, concat_ws(',', CASE WHEN p_retailprice > 1500 THEN 'missing_price' END, CASE WHEN p_brand = 'Brand#1' THEN 'missing_brand' END,
  CASE WHEN p_size % 5 = 0 AND p_type = 'SMALL' THEN 'weak_matching_identifiers' END, CASE WHEN contains(p_name, 'red') THEN 'destockage_review' END) AS flags FROM part""",
    "completeness_score": """SELECT event_id, CAST((event_type <> 'view')::INT + (value > 10)::INT AS BIGINT) AS score, 'shop:' || coalesce(nullif(event_type, 'view'), CAST(event_id AS VARCHAR)) AS fingerprint FROM events""",
    "strong_id_match": """WITH p AS (SELECT p_partkey AS product_id, CASE WHEN p_size < 15 THEN lpad(CAST(p_partkey AS VARCHAR), 13, '3') END AS ean, 'MR' || (p_partkey % 900) AS ref FROM part WHERE p_type IN ('ECONOMY', 'STANDARD', 'LARGE')),
o AS (SELECT p_partkey AS offer_id, CASE WHEN p_size < 15 THEN lpad(CAST(p_partkey + 1 AS VARCHAR), 13, '3') END AS ean, 'MR' || (p_partkey % 700) AS ref FROM part WHERE p_type NOT IN ('ECONOMY', 'STANDARD', 'LARGE')),
e AS (SELECT ean, min(product_id) AS a FROM p WHERE ean IS NOT NULL GROUP BY ean), r AS (SELECT ref, min(product_id) AS b FROM p GROUP BY ref HAVING count(*) = 1)
SELECT offer_id, coalesce(a, b) AS product_id, CASE WHEN a IS NOT NULL THEN 'ean' ELSE 'manufacturer_reference' END AS why FROM o LEFT JOIN e USING (ean) LEFT JOIN r USING (ref) WHERE coalesce(a, b) IS NOT NULL""",
    "token_overlap_pairs": f"""WITH o AS (SELECT p_partkey AS id, p_partkey % 3 AS m, list_distinct(list_filter(string_split('n' || (p_partkey // 3) || ' kk' || (p_partkey // 3) % 97 || ' zz' || (p_partkey // 3) % 89 || ' ' || lower(p_type), ' '), lambda x: len(x) > 1 AND x NOT IN ({_STOP}))) AS t
  FROM part),
w AS (SELECT id, m, len(t) AS n, unnest(t) AS token FROM o),
k AS (SELECT * FROM w WHERE len(token) >= 3)
SELECT x.id AS a, y.id AS b, count(*) AS common, count(*) / least(x.n, y.n) AS similarity FROM k x JOIN k y ON x.token = y.token AND x.id < y.id AND x.m <> y.m GROUP BY x.id, y.id, x.n, y.n HAVING count(*) >= 3""",
    "props_parse": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
}
