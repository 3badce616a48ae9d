"""Markers, offer blocks, cards and structured data of odd pages."""

import random
import time
from urllib.parse import urldefrag, urljoin

import pytest
from conftest import SF  # noqa: F401
from pyspark.sql import functions as F

from offerloom.functions import dom
from offerloom.operators import extract, pages, structured
from offerloom.queries import QUERIES, pages as listing_pages


def of_text(spark, text):
    return spark.createDataFrame([(1, text, "Titre")], "k long, text string, title string")


def of_html(spark, html):
    return spark.createDataFrame([(1, "https://s.example/l", html), (2, "https://s.example/m", None)], "k long, url string, html string").withColumn("page", dom.parse_page("html"))


ODD = "Réf. ACMED : 12345 Réf. fabricant : 4867A2 Réf. EAN : 3401234567890 Norme Réf. ISO : 25 En stock 12,50 € Réf. acmed:B-2 Réf. Fabricant : X1 3,00 € Sur commande"


def test_only_the_merchants_marker_begins_an_offer(spark):
    rows = {r.merchant_reference: r for r in extract.variants(of_text(spark, ODD), "text", "k", "ACMED").collect()}
    assert set(rows) == {"12345", "B-2"}
    assert (rows["12345"].price_eur, rows["12345"].availability, rows["12345"].manufacturer_reference) == (12.5, "En stock", "4867A2")
    assert (rows["B-2"].price_eur, rows["B-2"].availability) == (3.0, "Sur commande")
    named = {r.merchant_reference: (r.price_eur, r.availability) for r in extract.variant_offers(of_text(spark, ODD), "text", "k", "title", "acmed").collect()}
    assert named == {"12345": (12.5, "in_stock"), "B-2": (3.0, "on_order")}
    lines = extract.line_offers(of_text(spark, ODD.replace(" Réf.", "\nRéf.")), "text", "k", "title", "ACMED").collect()
    assert [(r.merchant_reference, r.ean) for r in sorted(lines, key=lambda r: r.position)] == [("12345", "3401234567890"), ("B-2", None)]
    assert extract.variants(of_text(spark, "Réf. EAN : 3401234567890 5,00 €"), "text", "k", "ACMED").count() == 0
    assert extract.variants(of_text(spark, "Réf. Grand  Dental : A1 5,00 €"), "text", "k", "Grand Dental").count() == 1
    assert extract.variants(of_text(spark, None), "text", "k", "ACMED").count() == 0


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("Réf. XYZABC Ajouter au panier", ["XYZABC"]), ("Réf Couleur bleue", ["Couleur"]), ("Référence produit ABC-123", []), ("Réf. Dentashop : DX-1 et SKU#S_1/2", ["DX-1", "S_1/2"]),
        ("Réf. dentashop DX-2", ["DX-2"]), ("Référence : AB", []), ("Réf. Dentashop", []),
    ],
)
def test_references_of_offer_blocks(spark, text, wanted):
    html = f"<h1>N</h1><p>Kit de ACME &amp; CO pour</p><div class='variation'>{text} 1 234,50 €</div>"
    rows = pages.block_offers(of_html(spark, html), "k", "url", "Dentashop").orderBy("position").collect()
    assert [r.merchant_reference for r in rows] == wanted
    assert all(r.brand == "ACME & CO" and r.price == 1234.5 for r in rows)


def test_graphs_of_any_depth(spark):
    product = '{"@type":"Product","name":"A","sku":"S1"}'
    html = '<script type="application/ld+json">' + '{"@graph":[{"@type":"Thing"},' * 12 + product + "]}" * 12 + "</script>"
    rows = structured.structured_products(spark.createDataFrame([(1, html), (2, None), (3, "<script type='application/ld+json'>[1,</script>")], "k long, html string"), "html", "k").collect()
    assert [(r.k, r.name, r.sku) for r in rows] == [(1, "A", "S1")]
    first = '<script type="application/ld+json">{"@graph":[%s]}</script><script type="application/ld+json">%s</script>' % (product, product.replace("S1", "S2"))
    rows = structured.structured_products(spark.createDataFrame([(1, first)], "k long, html string"), "html", "k").orderBy("at").collect()
    assert [r.sku for r in rows] == ["S2", "S1"]  # breadth first over all scripts


def card(i, inner=""):
    return f"<li class='product-item'><div class='item'><a href='/x/'>bild</a><a class='product-item-link' href='/p/{i}.html'>Name {i}</a><img src='/i/{i}.jpg'><b>Réf. R{i}</b><span>{i},50 €</span>{inner}</div></li>"


def test_cards_nested_and_broken(spark):
    html = card(1, card(2)) + "<div class='item'><a href='/none'>no product</a></div>" + "<div class='item'><a href='https://other.example/p/9.html'>elsewhere</a></div>" + card(1) + "<li class='item'><a href='/p/7.html'></a>"
    rows = pages.listing_cards(of_html(spark, html), "k", "url", ("s.example",)).orderBy("position").collect()
    assert [(r.k, r.source_url, r.name, r.image_url) for r in rows] == [(1, "https://s.example/p/1.html", "Name 1", "https://s.example/i/1.jpg"), (1, "https://s.example/p/2.html", "Name 2", "https://s.example/i/2.jpg")]
    assert [r.price_eur for r in rows] == [1.5, 2.5]


def test_links_and_cards_take_time_linear_in_the_page(spark):
    """Ten times the cards cost about ten times the time, and what leaves a page is no larger than the page."""
    took = {}
    for n in (200, 2000):
        html = "<ul>" + "".join(card(i) for i in range(n)) + "</ul>"
        df = of_html(spark, html)
        for _ in range(2):
            began = time.perf_counter()
            assert pages.listing_cards(df, "k", "url", ("s.example",)).count() == n
            assert pages.priced_links(df, "k", "url", "https://s.example").count() == n + 1
            assert pages.links_with_words(df, "k", "url", "https://s.example", ("Réf",)).count() == n + 1
            took[n] = time.perf_counter() - began
    assert took[2000] < 12 * took[200] + 3
    plan = pages.listing_cards(df, "k", "url", ("s.example",))._jdf.queryExecution().optimizedPlan().toString()
    assert "page#" not in plan.split("Aggregate")[1].split("\n")[0]


def test_texts_equal_the_pages_texts(spark):
    df = of_html(spark, "<h1> A <b>b</b></h1><p>x&nbsp;y</p><script>no</script><h1>c</h1>").withColumn("t", dom.parse_texts("html"))
    rows = df.select(F.col("t.pieces") == F.col("page.pieces"), F.col("t.heading").eqNullSafe(dom.heading(F.col("page")))).collect()
    assert [tuple(r) for r in rows] == [(True, True), (True, True)]


def test_addresses_equal_urljoin(spark):
    bases = ["https://s.example", "https://s.example/", "https://s.example/a/b/c.html?x=1#f", "http://s.example/a/", "https://s.example/a?q=/x/y"]
    hrefs = ["x.html", "./x", "../x", "../../../x?y=../z", "/r/./s/../t", "/..", "a/..", "a/.", "..", ".", "?p=2", "", "#top", "//h.example/a/../b", "https://t.example/a/../b#c", "mailto:a@b", "a//b/../c", "/a/b/", "x.html#y", "a...b/..c", "x?a=1#b"]
    rows = [(b, h) for b in bases for h in hrefs]
    got = spark.createDataFrame(rows, "b string, h string").select("b", "h", dom.absolute(F.col("b"), F.col("h")).alias("u")).collect()
    odd = [(r.b, r.h, r.u, urldefrag(urljoin(r.b, r.h))[0]) for r in got if r.u != urldefrag(urljoin(r.b, r.h))[0]]
    assert odd == []


def test_plain_pages_are_read_as_the_parser_reads_them():
    rng, classes = random.Random(7), frozenset(dom.CARD_CLASSES)
    parts = [
        *"<div>|</div>|<p class='a item'>|</p>|<li class=item>|</li>|<h1>|</h1>|<h1 id=x>T</h1>|text|&eacute;t&amp;|&nbsp;|<br/>|<img src='/a?b=1&amp;c' alt=x>|<td>|<tr>|<dt>|<dd>|é €".split("|"),
        '<script>var a="</p>";</script>', '<script type="application/ld+json">{"a":1}</script>', "<!-- c -->", "<!-->", "<!-- a -- b -->", "<SCRIPT>x</SCRIPT >", "<", "a < b", "<template>", "</template>", "<title>a<b></title>", "<a href=/x/>", "<p a='1'b=2>",
        "<script>", "</script>", "<x-y>", "<!doctype html>", "<p/ >", "<p ſ=1>", "\x00", "<style type='ld+json'>q</style>",
    ]
    n_plain = 0
    for _ in range(3000):
        page = "".join(rng.choices(parts[: rng.choice((21, len(parts)))], k=rng.choice((3, 8, 20))))
        n_plain += dom._plain(page, classes) is not None
        for known in (classes, frozenset()):
            builder = dom._Builder(known)
            builder.feed(page)
            builder.close()
            pieces, scripts, tags, until, parent, first, stop, attrs, cards = dom._parsed(page, known)
            names = ("tag", "at", "until", "parent", "first", "stop", "attrs", "cards")
            got = [dict(zip(names, e)) for e in zip(tags, range(len(tags)), until, parent, first, stop, map(dict, attrs), map(list, cards))]
            assert (pieces, scripts, got) == (builder.pieces, builder.scripts, builder.elements), page
        h1 = next((e for e in builder.elements if e["tag"] == "h1"), None)
        assert dom._texts(page) == (builder.pieces, h1 and (" ".join(builder.pieces[h1["first"] : h1["stop"]]).strip() or None)), page
    assert n_plain > 1000


def test_a_text_around_many_links_is_read_once(spark):
    """Links without a price of their own all get it from the list; each by itself would make some gigabytes of text."""
    n = 6000
    cards = "".join(f'<li><div><a href="/p/{i}">{"Produit de la maison " * 4}{i}</a></div></li>' for i in range(n))
    df = of_html(spark, f"<ul>{cards}<li>Réf. R1 7,25 €</li></ul>").filter("k = 1")
    began = time.time()
    rows = pages.priced_links(df, "k", "url", "https://s.example").agg(F.count("*"), F.min("price"), F.max("price"), F.min("merchant_reference")).first()
    assert tuple(rows) == (n, 7.25, 7.25, "R1")
    assert time.time() - began < 30


@pytest.mark.parametrize("name, times", [("family_extract", 1), ("block_offers_extract", 1), ("line_offers_with_skus", 1), ("product_page_extract", 2), ("fallback_page_extract", 2)])
def test_pages_are_parsed_once(spark, name, times):
    """One step for the page, one for its structured data; a page is neither parsed again nor joined to what was read from it."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == times and "Join" not in plan


def test_listings_do_not_grow_with_the_table(spark, tmp_path):
    longest = []
    for n in (10_000, 40_000):
        part = spark.range(n).select(F.col("id").alias("p_partkey"), F.concat(F.lit("Brand#"), F.col("id") % 3).alias("p_brand"), F.lit("n").alias("p_name"), F.lit(10).alias("p_size"))
        part.write.parquet(f"{tmp_path}/{n}/part.parquet")
        longest.append(listing_pages._listings(spark, f"{tmp_path}/{n}").agg(F.max(F.length("html"))).first()[0])
        assert QUERIES["links_with_words_extract"](spark, f"{tmp_path}/{n}").count() == n + 3
    assert longest[1] < 1.1 * longest[0]


def test_lines_and_blocks_of_offers_are_read_once(spark):
    """Filters on offers repeat no rule, and what a rule asks for is found where it was found before."""
    rows = of_text(spark, "Réf. ACMED : A1\nNom 1234567890123 1 234,50 €\nRéf. Fabricant : X9\nEn stock 12.345,6€ Réf. ACMED : Réf. ACMED : B2 TEINTE : A2\nRéf. Fabricant Y1 EN STOCK 7 €")
    variants = extract.variant_offers(rows, "text", "k", "title", "ACMED")
    lines = extract.line_offers(rows, "text", "k", "title", "ACMED", extract.CAPTURE_LINES)
    assert [(r.position, r.merchant_reference, r.manufacturer_reference, r.name, r.price_eur, r.availability) for r in variants.orderBy("position").collect()] == [
        (0, "A1", "X9", "Nom 1234567890123 1 234,50 €", 12345.6, "in_stock"), (2, "B2", "Y1", "Titre", 7.0, "in_stock"),
    ]
    assert [(r.merchant_reference, r.name) for r in lines.orderBy("position").collect()] == [("A1", "Nom 1234567890123 1 234,50 €"), ("B2", "Titre")]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(lines).count("\\R") == 1 and plan(variants).count("TEINTE") == 1
