"""Pages in the layouts of shops, built from the driver's tables, and what is read from them.

The SQL knows nothing of pages: it says from the tables what must be found on them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, functions as F

from offerloom.functions import dom
from offerloom.operators import extract, pages, structured
from offerloom.plans.lineage import shared_dir
from offerloom.queries.views import table
from offerloom.sources import readers, writers

SITE = "https://www.shop.example"
_LINE_ORDER = ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")


def _html(body: Column, head: Column | str = "") -> Column:
    return F.concat(F.lit("<!doctype html><html><head><title>Boutique</title>"), F.lit(head) if isinstance(head, str) else head, F.lit("</head><body>"), body, F.lit("<script>var x = '9,99 €';</script></body></html>"))


def _tag(tag: str, *parts, attrs: str = "") -> Column:
    return F.concat(F.lit(f"<{tag}{' ' + attrs if attrs else ''}>"), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit(f"</{tag}>"))


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _stock() -> Column:
    return F.when(F.col("l_returnflag") == "A", "En stock").when(F.col("l_returnflag") == "N", "SUR COMMANDE").otherwise("Arrêté")


def _price() -> Column:
    return F.when(F.col("l_returnflag") != "R", F.concat(F.lit("1 "), F.lpad(F.col("l_quantity").cast("int").cast("string"), 3, "0"), F.lit(",50&nbsp;€"))).otherwise("")


def _order_pages(spark, d, line: Column, before: Column | None = None, parse=dom.parse_page):
    """A page per order, with ``line`` for each of its line items."""
    lines = F.array_sort(F.collect_list(F.struct(*_LINE_ORDER, line.alias("line"))))["line"]
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(lines, "").alias("body"))
    body = F.concat(before if before is not None else F.lit(""), F.lit("<h1>Commande "), _text("l_orderkey"), F.lit("</h1>"), F.col("body"))
    rows = rows.select("l_orderkey", F.concat(F.lit(f"{SITE}/c/"), _text("l_orderkey"), F.lit(".html")).alias("url"), _html(body).alias("html"))
    return rows.withColumn("page", parse("html"))


def _variant_line(named_last: bool = False) -> Column:
    name, shade = _tag("p", "Variante ", _text("l_partkey")), _tag("p", "TEINTE : A2")
    return F.concat(_tag("div", "Réf. SHOP : ", F.concat(F.lit("L"), _text("l_linenumber"))), *((shade, name) if named_last else (name, shade)), _tag("p", "Réf. Fabricant : M", _text("l_partkey")), _tag("p", "Norme Réf. ISO : 25"), _tag("p", "Réf. EAN : 34012", F.lpad(_text("l_partkey"), 8, "0")), _tag("p", _stock()), _tag("p", _price()))


def _with_text(rows, sign: str = " "):
    return rows.withColumns({"text": dom.page_text(F.col("page"), sign), "title": dom.heading(F.col("page"))})


def _texts(spark, d, line: Column, sign: str = " "):
    """The texts of the orders' pages, without their elements."""
    rows = _order_pages(spark, d, line, parse=dom.parse_texts)
    return rows.select("l_orderkey", "url", dom.page_text(F.col("page"), sign).alias("text"), F.col("page.heading").alias("title"))


def block_split_extract(spark, d):
    """Variant blocks of a page text: the last block of a reference wins, and the maker's reference starts no block."""
    return extract.variants(_texts(spark, d, _variant_line()), "text", "l_orderkey", "Shop").drop("position")


def variant_offers_extract(spark, d):
    found = extract.variant_offers(_texts(spark, d, _variant_line()), "text", "l_orderkey", "title", "SHOP")
    return found.withColumn("position", F.col("position").cast("long"))


def line_offers_extract(spark, d):
    found = extract.line_offers(_texts(spark, d, _variant_line(), "\n"), "text", "l_orderkey", "title", "SHOP")
    return found.drop("position")


def line_offers_with_skus(spark, d):
    """The last line item is told by an element alone."""
    sku = F.concat(F.lit('<div class="product-info-main"><div class="sku"><b class="value">L1</b></div></div><meta itemprop="sku" content="X'), _text("l_orderkey"), F.lit('">'))
    rows = _with_text(_order_pages(spark, d, _variant_line(), sku), "\n").withColumn("skus", pages.page_skus(F.col("page")))
    return extract.line_offers(rows, "text", "l_orderkey", "title", "SHOP", extract.FAST_LINES, skus="skus").select("l_orderkey", "merchant_reference", "manufacturer_reference", "name", "price_eur", "availability")


def line_offers_of_captures(spark, d):
    return extract.line_offers(_texts(spark, d, _variant_line(True), "\n"), "text", "l_orderkey", "title", "SHOP", extract.CAPTURE_LINES).select("l_orderkey", "merchant_reference", "name", "price_eur")


def saved_page_offers(spark, d):
    """Pages saved as files, read back, as offers."""
    folder = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    _order_pages(spark, d, _variant_line()).select(F.translate("html", "\n", " ").alias("value")).write.text(folder, lineSep="\n")
    saved = spark.read.text(folder).select(F.monotonically_increasing_id().alias("page_id"), dom.parse_texts("value").alias("page"))
    saved = saved.select("page_id", dom.page_text(F.col("page")).alias("text"), F.col("page.heading").alias("title"))
    found = extract.variant_offers(saved, "text", "page_id", "title", "SHOP")
    return found.groupBy("availability").agg(F.count(F.lit(1)).alias("n"), F.count("price_eur").alias("n_priced"), F.round(F.sum("price_eur"), 2).alias("total"))


def family_extract(spark, d):
    """Families of numeric references with an image for each. A price's thousands stay with the variant, as the rule for its end says."""
    line = F.concat(F.lit('<img src="/img/logo.png"><img alt="photo 1000'), _text("l_linenumber"), F.lit('" src="/img/'), F.translate(_text("l_orderkey"), "0123456789", "abcdefghij"), F.lit("-"), _text("l_linenumber"), F.lit('.jpg">'), _tag("p", "Réf 1000", _text("l_linenumber"), " Taille ", _text("l_partkey"), " "), _tag("p", _price()), _tag("p", "Réf fabriquant : M", _text("l_partkey")), _tag("p", _stock()))
    rows = _with_text(_order_pages(spark, d, line)).withColumns({"pictures": pages.images(F.col("page")), "cover": dom.meta(F.col("page"), "og:image")})
    image = lambda reference: pages.image_among(F.col("pictures"), F.col("cover"), reference, F.col("url"))
    return extract.family_offers(rows, "text", "l_orderkey", beside={"image_url": image}).drop("position")


def block_offers_extract(spark, d):
    """Offer blocks with an old price before the price; orders of few items have no blocks, but a sku."""
    block = F.when(F.col("l_quantity") > 10, F.concat(F.lit('<div class="box product-variation">'), _tag("span", "Réf. SHOP : AB", _text("l_linenumber")), F.lit("<s>9 999,00 €</s><i>Référence produit ABC-123</i><i>Kit de ACME PRO+ vendu</i>"), F.when(F.col("l_linenumber") == 2, "<u>Réf. XYZABC Ajouter au panier</u>").otherwise(""), _tag("b", "1 ", F.lpad(F.col("l_quantity").cast("int").cast("string"), 3, "0"), ",50 €"), F.lit("</div>"))).otherwise("")
    sku = F.concat(F.lit('<meta itemprop="sku" content="S'), _text("l_orderkey"), F.lit('"><meta property="og:image" content="/i/'), _text("l_orderkey"), F.lit('.png"><ul class="breadcrumb"><li><a href="/">Accueil</a></li><li><a href="/c">Soins</a></li></ul>'))
    return pages.block_offers(_order_pages(spark, d, block, sku), "l_orderkey", "url", "Shop").drop("position")


def _part_pages(spark, d, body: Column, head: Column | str = ""):
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit(f"{SITE}/produit/"), _text("p_partkey"), F.lit(".html")).alias("url"), _html(body, head).alias("html"))
    return rows.withColumn("page", dom.parse_page("html"))


def net_price_extract(spark, d):
    body = F.concat(
        F.when(F.col("p_partkey") % 2 == 0, _tag("h1", F.col("p_name"), " - Réf: IN", _text("p_partkey"))).otherwise(_tag("h1", F.col("p_name"))),
        F.lit('<ol class="breadcrumb"><li>Accueil</li><li>'), F.col("p_type"), F.lit('</li></ol><div class="product-manufacturer">'), F.replace("p_brand", F.lit("#"), F.lit(" ")),
        F.lit('</div><p>10,00 € TTC</p><p>'), _text("p_size"), F.lit(",90 € HT</p><p>REF : TX"), _text("p_partkey"), F.lit("</p><img itemprop=image src='/i/"), _text("p_partkey"), F.lit(".jpg'>"), F.when(F.col("p_size") > 20, "<p>en stock</p>").otherwise("<p>Stock épuisé</p>"),
    )
    return pages.net_price_pages(_part_pages(spark, d, body), "p_partkey", "url")


def _ld(*fields: tuple[str, Column | str]) -> Column:
    parts = []
    for name, value in fields:
        parts += [F.lit(f'{"," if parts else ""}"{name}":'), F.lit(value) if isinstance(value, str) else value]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def _quoted(c: Column | str) -> Column:
    return F.concat(F.lit('"'), F.lit(c) if isinstance(c, str) else c, F.lit('"'))


def _script(body: Column) -> Column:
    return F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))


def _shaped_product() -> Column:
    """A product in one of four shapes: alone, in a list, in a graph (also four graphs deep), with everything as lists."""
    plain = [("name", _quoted(F.col("p_name"))), ("sku", _quoted(F.concat(F.lit("S"), _text("p_partkey")))), ("mpn", _quoted(F.when(F.col("p_size") % 5 == 0, "N/C").otherwise(F.concat(F.lit("M-"), _text("p_partkey"))))), ("gtin13", _quoted(F.lpad(_text("p_partkey"), 13, "3")))]
    price = F.concat(_text("p_size"), F.lit(".50"))
    one = _ld(("@type", '"Product"'), *plain, ("brand", _ld(("name", _quoted(F.col("p_brand"))))), ("image", '"/a.png"'), ("offers", _ld(("price", price), ("availability", '"https://schema.org/InStock"'))))
    flat = _ld(("@type", '["Thing","Product"]'), *plain, ("brand", _quoted(F.col("p_brand"))), ("image", '["/b.png","/c.png"]'), ("offers", F.concat(F.lit("["), _ld(("price", _quoted(price)), ("availability", '"OutOfStock"')), F.lit("]"))))
    shape = F.col("p_partkey") % 4
    listed = F.concat(F.lit('[{"@type":"WebPage"},'), one, F.lit("]"))
    deeper = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('{"@graph":[{"@graph":[{"@graph":['), flat, F.lit("]}]}]}"))).otherwise(flat)
    graph = F.concat(F.lit('{"@context":"x","@graph":[{"@type":"BreadcrumbList"},'), deeper, F.lit("]}"))
    return F.concat(_script(F.lit("{broken")), F.when(shape == 0, _script(one)).when(shape == 1, _script(listed)).when(shape == 2, _script(graph)).otherwise(_script(flat)))


def structured_product_extract(spark, d):
    return structured.structured_product(_part_pages(spark, d, F.lit("<p>rien</p>"), _shaped_product()), "p_partkey").drop("category")


def page_offer_extract(spark, d):
    """Offers at any depth, else in the text."""
    deep = _script(_ld(("a", F.concat(F.lit('[{"b":{"offers":{"lowPrice":"1 '), F.lpad(_text("p_size"), 3, "0"), F.lit(',25","availability":"https://schema.org/InStock"}}}]')))))
    body = F.concat(F.when(F.col("p_partkey") % 2 == 0, deep).otherwise(""), F.lit("<p>2&#8239;"), F.lpad(_text("p_size"), 3, "0"), F.lit(",75 €</p><p>sur commande</p>"))
    return pages.page_offer(_part_pages(spark, d, body), "p_partkey")


def product_page_extract(spark, d):
    """Fields told by elements, structured data, labels or the text, as a page has them."""
    kind = F.col("p_partkey") % 3
    price = F.when(kind == 0, F.concat(F.lit('<meta itemprop="price" content="'), _text("p_size"), F.lit('.25">'))).when(kind == 1, F.concat(F.lit('<div class="special-price"><span class="price">'), _text("p_size"), F.lit(",75 €</span></div>")))
    price = price.otherwise(F.concat(F.lit('<div class="price-box"><i>avant</i><span class="price">1.0'), F.lpad(_text("p_size"), 2, "0"), F.lit(",00 €</span></div>")))
    sku = F.when(kind == 0, F.concat(F.lit('<span itemprop="sku">S'), _text("p_partkey"), F.lit("</span>"))).when(kind == 1, F.concat(F.lit('<form data-product-sku="D'), _text("p_partkey"), F.lit('"></form>'))).otherwise(F.concat(F.lit("<table><tr><th>SKU</th><td>T"), _text("p_partkey"), F.lit("</td></tr></table>")))
    labels = F.concat(F.lit("<table><tr><th>Marque</th><td>"), F.col("p_brand"), F.lit("</td></tr><tr><th>Réf. fabricant</th><td>"), F.when(F.col("p_size") % 7 == 0, "Non renseigné").otherwise(F.concat(F.lit("F"), _text("p_partkey"))), F.lit("</td></tr></table><dl><dt>EAN</dt><dd>"), F.lpad(_text("p_partkey"), 13, "4"), F.lit("</dd></dl>"))
    trail = F.concat(F.lit('<div class="breadcrumbs"><a href="/">Accueil</a><a href="/x">'), F.col("p_type"), F.lit("</a><a href='/y'>Page</a></div>"))
    body = F.concat(trail, _tag("h1", F.col("p_name"), " &eacute;tui"), price, sku, labels, F.when(F.col("p_size") > 25, "<p>Rupture de stock, bientôt disponible</p>").otherwise("<p>en stock</p>"))
    rows = _part_pages(spark, d, body, F.concat(F.lit('<meta property="og:image" content="/o/'), _text("p_partkey"), F.lit('.png">')))
    return pages.product_pages(rows, "p_partkey", "url").drop("source_url")


def fallback_page_extract(spark, d):
    body = F.concat(_tag("h1", F.col("p_name")), F.lit("<p>Code fabricant : F"), _text("p_partkey"), F.lit("</p><p>Réf. : R"), _text("p_partkey"), F.lit("</p><p>Prix "), _text("p_size"), F.lit(",50 €</p><p>Sur commande</p>"))
    rows = _part_pages(spark, d, body, F.when(F.col("p_partkey") % 2 == 0, _shaped_product()).otherwise(""))
    return pages.fallback_pages(rows, "p_partkey", "url").select("p_partkey", "name", "price", "merchant_reference", "manufacturer_reference", "brand", "ean", "availability")


#: Fixed value: part keys whose cards share a listing page; some hundred of them are of one brand.
_KEYS_PER_LISTING = 10_000


def _listings(spark, d, paged: bool = True):
    """Listing pages of brands with a card for each of their parts; every second card tells its own brand and amount.

    ``paged`` as shops do it, a page for the parts of a range of keys, so more parts make more pages and no larger ones; else one page per brand.
    """
    odd = F.col("p_partkey") % 2 == 1
    card = F.concat(
        F.lit('<li class="item product-item"><div class="product-item-info"><a class="photo" href="/img/"><img src="/ph.gif" data-src="/p/'), _text("p_partkey"), F.lit('.jpg"></a><a class="product-item-link" href="/produit/'), _text("p_partkey"),
        F.lit('.html?utm=1#top"> '), F.col("p_name"), F.lit(" </a><span>Réf. R"), _text("p_partkey"), F.lit(".</span>"), F.when(odd, F.concat(F.lit('<em class="card-brand">Maison</em><span data-price-amount="'), _text("p_size"), F.lit('.5">x</span>'))).otherwise(F.concat(F.lit("<span>"), _text("p_size"), F.lit(",25 €</span>"))),
        F.lit("<p>Ajouter au panier</p></div></li>"),
    )
    number = F.coalesce(F.floor(F.col("p_partkey") / _KEYS_PER_LISTING).cast("string"), F.lit("")) if paged else F.lit("")
    rows = table(spark, d, "part").groupBy("p_brand", number.alias("number")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("p_partkey", card.alias("card"))))["card"], "").alias("cards"))
    slug = F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]+", "-"))
    heading = F.when(F.length("p_brand") % 2 == 0, F.concat(F.lit("<h1>Marque : "), F.col("p_brand"), F.lit("</h1>"))).otherwise("<h1>Liste</h1>")
    foot = F.concat(F.lit('<a href="https://autre.example/z.html">Ajouter</a><a class="action next" href="/'), F.when(F.col("p_brand").rlike("[13579]$"), F.concat(F.lit("brands/"), slug)).otherwise("brands/ailleurs"), F.lit('?p=2&amp;sort=asc">Suivante</a>'))
    rows = rows.select("p_brand", F.concat(F.lit(f"{SITE}/brands/"), slug, F.when(F.col("number") != "", F.concat(F.lit("?p="), F.col("number"))).otherwise("")).alias("url"), _html(F.concat(heading, F.lit("<ul>"), F.col("cards"), F.lit("</ul>"), foot)).alias("html"))
    return rows.withColumn("page", dom.parse_page("html"))


def listing_cards_extract(spark, d):
    rows = _listings(spark, d)
    rows = rows.withColumn("brand", pages.listing_brand(F.col("page"), F.col("url")))
    return pages.listing_cards(rows, "p_brand", "url", ("www.shop.example",), "brand").drop("position")


def priced_links_extract(spark, d):
    return pages.priced_links(_listings(spark, d, paged=False), "p_brand", "url", SITE).drop("text")


def links_with_words_extract(spark, d):
    return pages.links_with_words(_listings(spark, d), "p_brand", "url", SITE, ("€", "Ajouter"), ("/img/",))


def next_page_extract(spark, d):
    """Where a brand's listing goes on; all its pages say the same."""
    return pages.next_page(_listings(spark, d), "p_brand", "url").distinct()


def harvested_addresses(spark, d):
    """Addresses of a sitemap, a text and a page, with what is no product left out."""
    p = table(spark, d, "part")
    address = F.concat(F.lit("https://www.shop.example/produit/"), _text("p_partkey"), F.lit(".html"))
    lines = {0: F.concat(F.lit("<url><loc>"), address, F.lit("</loc></url>")), 1: F.concat(F.lit("voir "), address, F.lit(" !")), 2: F.concat(F.lit('<a href="/produit/'), _text("p_partkey"), F.lit('.html?a=1&amp;b=2">x</a><a href="/contact/a.html">c</a>'))}
    text = lines[0]
    for kind in (1, 2):
        text = F.when(F.col("p_partkey") % 3 == kind, lines[kind]).otherwise(text)
    return pages.harvested(p.select("p_partkey", F.concat(text, F.lit(" https://www.shop.example/media/z.html https://other.example/q.html")).alias("text")), "text", "p_partkey", ("www.shop.example", "shop.example"), f"{SITE}/")


def page_reading(spark, d):
    """What the pages hold: links, list items, paragraphs, headings of the first kind, classed parts."""
    p = table(spark, d, "pages").select("page_id", dom.parse_page("html").alias("page"))
    n = lambda test: F.size(dom.elements(F.col("page"), test)).cast("long")
    return p.select(
        "page_id", n(lambda e: (e["tag"] == "a") & dom.attr(e, "href").isNotNull()).alias("n_links"), n(lambda e: e["tag"] == "li").alias("n_items"),
        n(lambda e: e["tag"] == "p").alias("n_paragraphs"), n(lambda e: e["tag"] == "h1").alias("n_headings"), n(lambda e: dom.has_class(e, "ad")).alias("n_ads"),
    )


def saved_page_tree(spark, d):
    """Pages saved one by one in a tree of folders, with files that are none, read back: names, sizes and texts."""
    folder = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    pages_ = table(spark, d, "pages").select("page_id", "html", F.concat(F.col("page_id") % 7, F.lit("/p"), F.col("page_id")).alias("name"))
    written = writers.page_files(pages_, "name", "html", folder)
    spark.range(1).select(F.lit("no page").alias("value")).write.text(f"{folder}/notes")
    found = readers.html_pages(spark, folder).select(F.regexp_extract("file", "([0-9]+/p[0-9]+)[.]html$", 1).alias("name"), F.md5("html").alias("html_md5"))
    return found.join(written, "name").select("name", "n_bytes", "html_md5")


QUERIES = {f.__name__: f for f in (
    block_split_extract, variant_offers_extract, line_offers_extract, line_offers_with_skus, line_offers_of_captures, saved_page_offers, family_extract, block_offers_extract, net_price_extract,
    structured_product_extract, page_offer_extract, product_page_extract, fallback_page_extract, listing_cards_extract, priced_links_extract, links_with_words_extract, next_page_extract, harvested_addresses, page_reading, saved_page_tree,
)}

_LINES = """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) - 1 AS place,
  CASE l_returnflag WHEN 'A' THEN 'En stock' WHEN 'N' THEN 'Sur commande' ELSE 'Arrêté' END AS stock, CASE WHEN l_returnflag <> 'R' THEN 1000.5 + CAST(l_quantity AS INTEGER) END AS price FROM lineitem)
"""
_LAST = "QUALIFY row_number() OVER (PARTITION BY l_orderkey, {} ORDER BY place DESC) = 1"
_FIRST = "QUALIFY row_number() OVER (PARTITION BY l_orderkey, {} ORDER BY place) = 1"
_AS_WRITTEN = "CASE stock WHEN 'Sur commande' THEN 'SUR COMMANDE' ELSE stock END"
_NORMAL = "CASE l_returnflag WHEN 'A' THEN 'in_stock' WHEN 'N' THEN 'on_order' ELSE 'discontinued' END"
_SLUG = "lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '-', 'g'))"
ORACLES = {
    "page_reading": r"""SELECT page_id, CAST(len(regexp_extract_all(html, '<a\s[^>]*href=')) AS BIGINT) AS n_links, CAST(len(regexp_extract_all(html, '<li[\s>]')) AS BIGINT) AS n_items, CAST(len(regexp_extract_all(html, '<p[\s>]')) AS BIGINT) AS n_paragraphs,
  CAST(len(regexp_extract_all(html, '<h1[\s>]')) AS BIGINT) AS n_headings, CAST(len(regexp_extract_all(html, 'class="ad"')) AS BIGINT) AS n_ads FROM pages""",
    "saved_page_tree": "SELECT page_id % 7 || '/p' || page_id AS name, CAST(strlen(html) AS BIGINT) AS n_bytes, md5(html) AS html_md5 FROM pages",
    "block_split_extract": _LINES + "SELECT l_orderkey, 'L' || l_linenumber AS merchant_reference, 'M' || l_partkey AS manufacturer_reference, price AS price_eur, stock AS availability FROM l " + _LAST.format("l_linenumber"),
    "variant_offers_extract": _LINES + f"""SELECT l_orderkey, min(place) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey) AS position, 'L' || l_linenumber AS merchant_reference, 'M' || l_partkey AS manufacturer_reference,
  'Variante ' || l_partkey AS name, price AS price_eur, {_NORMAL} AS availability FROM l """ + _LAST.format("l_linenumber, l_partkey"),
    "line_offers_extract": _LINES + f"""SELECT l_orderkey, 'L' || l_linenumber AS merchant_reference, 'M' || l_partkey AS manufacturer_reference, '34012' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS ean, 'Variante ' || l_partkey AS name, 'Variante ' || l_partkey AS variant,
  price AS price_eur, {_AS_WRITTEN} AS availability FROM l """ + _FIRST.format("l_linenumber"),
    "line_offers_with_skus": _LINES + f"""SELECT l_orderkey, 'L' || l_linenumber AS merchant_reference, 'M' || l_partkey AS manufacturer_reference, 'Variante ' || l_partkey AS name, price AS price_eur, {_AS_WRITTEN} AS availability FROM l {_FIRST.format('l_linenumber')}
UNION ALL SELECT l_orderkey, 'X' || l_orderkey, NULL, 'Commande ' || l_orderkey, first(price ORDER BY place) FILTER (WHERE price IS NOT NULL), NULL FROM l GROUP BY l_orderkey
UNION ALL SELECT l_orderkey, 'L1', NULL, 'Commande ' || l_orderkey, first(price ORDER BY place) FILTER (WHERE price IS NOT NULL), NULL FROM l GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_linenumber = 1) = 0""",
    "line_offers_of_captures": _LINES + "SELECT l_orderkey, 'L' || l_linenumber AS merchant_reference, 'Variante ' || l_partkey AS name, price AS price_eur FROM l " + _FIRST.format("l_linenumber"),
    "saved_page_offers": _LINES + f""", k AS (SELECT {_NORMAL} AS availability, price FROM l {_LAST.format('l_linenumber, l_partkey')})
SELECT availability, count(*) AS n, count(price) AS n_priced, round(sum(price), 2) AS total FROM k GROUP BY availability""",
    "family_extract": _LINES + f"""SELECT l_orderkey, '1000' || l_linenumber AS merchant_reference, 'M' || l_partkey AS manufacturer_reference, 'Taille ' || l_partkey || CASE WHEN price IS NULL THEN '' ELSE ' 1' END AS variant, price AS price_eur, stock AS availability,
  '{SITE}/img/' || translate(CAST(l_orderkey AS VARCHAR), '0123456789', 'abcdefghij') || '-' || l_linenumber || '.jpg' AS image_url FROM l """ + _FIRST.format("l_linenumber"),
    "block_offers_extract": _LINES + f""", b AS (SELECT l_orderkey, 'AB' || l_linenumber AS merchant_reference, 1000.5 + CAST(l_quantity AS INTEGER) AS price FROM (SELECT * FROM l WHERE l_quantity > 10) {_FIRST.format('l_linenumber')}),
a AS (SELECT *, 'ACME PRO+' AS brand FROM b UNION ALL SELECT l_orderkey, 'XYZABC', price, 'ACME PRO+' FROM b WHERE merchant_reference = 'AB2'
      UNION ALL SELECT DISTINCT l_orderkey, 'S' || l_orderkey, NULL, '' FROM l WHERE l_orderkey NOT IN (SELECT l_orderkey FROM b))
SELECT l_orderkey, merchant_reference, 'Commande ' || l_orderkey AS name, brand, price, 'Soins' AS category, '{SITE}/i/' || l_orderkey || '.png' AS image_url FROM a""",
    "net_price_extract": f"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'IN' ELSE 'TX' END || p_partkey AS merchant_reference, p_name AS name, replace(p_brand, '#', ' ') AS brand, 'Accueil > ' || p_type AS category, p_size + 0.9 AS price_eur,
  CASE WHEN p_size > 20 THEN 'En stock' ELSE 'Stock épuisé' END AS availability, '{SITE}/i/' || p_partkey || '.jpg' AS image_url, '{SITE}/produit/' || p_partkey || '.html' AS source_url FROM part""",
    "structured_product_extract": """SELECT p_partkey, p_name AS name, 'S' || p_partkey AS sku, CASE WHEN p_size % 5 <> 0 THEN 'M-' || p_partkey END AS manufacturer_reference, lpad(CAST(p_partkey AS VARCHAR), 13, '3') AS ean, p_brand AS brand,
  CASE WHEN p_partkey % 4 < 2 THEN '/a.png' ELSE '/b.png' END AS image, p_size + 0.5 AS price_eur, CASE WHEN p_partkey % 4 < 2 THEN 'InStock' ELSE 'OutOfStock' END AS availability FROM part""",
    "page_offer_extract": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1000.25 + p_size ELSE 2000.75 + p_size END AS price_eur, CASE WHEN p_partkey % 2 = 0 THEN 'InStock' ELSE 'Sur commande' END AS availability FROM part",
    "product_page_extract": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'D' ELSE 'T' END || p_partkey AS merchant_reference, CASE WHEN p_size % 7 <> 0 THEN 'F' || p_partkey END AS manufacturer_reference, lpad(CAST(p_partkey AS VARCHAR), 13, '4') AS ean,
  p_name || ' étui' AS name, p_brand AS brand, p_type AS category, CASE p_partkey % 3 WHEN 0 THEN p_size + 0.25 WHEN 1 THEN p_size + 0.75 ELSE 1000.0 + p_size END AS price_eur,
  CASE WHEN p_size > 25 THEN 'Rupture de stock' ELSE 'en stock' END AS availability, '/o/' || p_partkey || '.png' AS image_url FROM part""",
    "fallback_page_extract": """SELECT p_partkey, p_name AS name, p_size + 0.5 AS price, 'R' || p_partkey AS merchant_reference, 'F' || p_partkey AS manufacturer_reference, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS brand,
  CASE WHEN p_partkey % 2 = 0 THEN lpad(CAST(p_partkey AS VARCHAR), 13, '3') END AS ean, CASE WHEN p_partkey % 2 = 0 THEN 'unknown' ELSE 'on_order' END AS availability FROM part""",
    "listing_cards_extract": f"""SELECT p_brand, '{SITE}/produit/' || p_partkey || '.html' AS source_url, p_name AS name, 'R' || p_partkey AS merchant_reference,
  CASE WHEN p_partkey % 2 = 1 THEN 'Maison' WHEN length(p_brand) % 2 = 0 THEN p_brand ELSE upper(replace({_SLUG}, '-', ' ')) END AS brand, p_size + CASE WHEN p_partkey % 2 = 1 THEN 0.5 ELSE 0.25 END AS price_eur, '{SITE}/p/' || p_partkey || '.jpg' AS image_url FROM part""",
    "priced_links_extract": f"""WITH c AS (SELECT *, min(p_partkey) FILTER (WHERE p_partkey % 2 = 0) OVER (PARTITION BY p_brand) AS priced, min(p_partkey) OVER (PARTITION BY p_brand) AS top FROM part)
SELECT p_brand, '{SITE}/produit/' || p_partkey || '.html?utm=1' AS href, 'R' || CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE top END || '.' AS merchant_reference, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE (SELECT q.p_size FROM part q WHERE q.p_partkey = c.priced) END + 0.25 AS price FROM c WHERE priced IS NOT NULL
UNION ALL SELECT p_brand, '{SITE}/img/', 'R' || min(p_partkey) || '.', (SELECT q.p_size + 0.25 FROM part q WHERE q.p_partkey = min(c.priced)) FROM c WHERE priced IS NOT NULL GROUP BY p_brand
UNION ALL SELECT p_brand, '{SITE}/brands/' || CASE WHEN regexp_matches(p_brand, '[13579]$') THEN {_SLUG} ELSE 'ailleurs' END || '?p=2&sort=asc', 'R' || min(top) || '.', (SELECT q.p_size + 0.25 FROM part q WHERE q.p_partkey = min(c.priced)) FROM c WHERE priced IS NOT NULL GROUP BY p_brand""",
    "links_with_words_extract": f"""SELECT p_brand, '{SITE}/produit/' || p_partkey || '.html?utm=1' AS href FROM part
UNION ALL SELECT DISTINCT p_brand, '{SITE}/brands/' || CASE WHEN regexp_matches(p_brand, '[13579]$') THEN {_SLUG} ELSE 'ailleurs' END || '?p=2&sort=asc' FROM part""",
    "next_page_extract": f"SELECT DISTINCT p_brand, CASE WHEN regexp_matches(p_brand, '[13579]$') THEN '{SITE}/brands/' || {_SLUG} || '?p=2' END AS next_url FROM part",
    "harvested_addresses": "SELECT p_partkey, 'https://www.shop.example/produit/' || p_partkey || '.html' || CASE WHEN p_partkey % 3 = 2 THEN '?a=1&b=2' ELSE '' END AS url FROM part",
}
