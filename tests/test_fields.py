"""Pinned values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from offerloom.functions import text as tx
from offerloom.functions.similarity import token_set
from offerloom.operators import classify, extract, matching


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("given, wanted", [("1 234,56 €", 1234.56), ("1 234,56 €", 1234.56), ("1.234,56 €", 1234.56), ("1234.56 EUR", 1234.56), ("1.234 €", 1.234), ("12.345.678", None), (None, None), ("Réf 12 - 45,90 €", 12.0), ("36,1", 36.1), ("0,00 €", 0.0), ("42.4", 42.4)])
def test_price(spark, given, wanted):
    assert one(spark, given, tx.parse_price) == wanted


@pytest.mark.parametrize("given, wanted", [("En stock", "in_stock"), ("Disponible", "in_stock"), ("Indisponible", "in_stock"), ("En réapprovisionnement Disponible sous 3 jours", "in_stock"), ("Sur commande", "on_order"), ("En réapprovisionnement", "backorder"), ("Rupture de stock", "backorder"), ("Arrêté", "discontinued"), ("https://schema.org/InStock", "unknown"), ("Stock épuisé", "unknown"), ("", None)])
def test_stock(spark, given, wanted):
    assert one(spark, given, tx.normalize_stock) == wanted


def test_stock_corrected(spark):
    assert one(spark, "Indisponible", lambda c: tx.normalize_stock(c, compat=False)) == "discontinued"


@pytest.mark.parametrize("given, wanted", [("L’Été – n°5 &amp; Co", "l ete n 5 co"), ("ﬁne Œuvre", "fine uvre"), ("ß", ""), ("Ø 2,5 mm", "2 5 mm"), ("½ dose", "1 2 dose"), (None, "")])
def test_fold(spark, given, wanted):
    assert one(spark, given, tx.fold) == wanted


@pytest.mark.parametrize("given, wanted", [("Boîte de 100 gants", "boite de 100 100 gants"), ("10 x 5 g poudre", "10 5 g"), ("10 × 5 g", "5 g"), ("Flacon 1,5 ml", "5 ml"), ("Coffret de 6 limes 21 mm", "coffret de 6 6 limes")])
def test_packaging(spark, given, wanted):
    assert one(spark, given, tx.extract_packaging) == wanted


@pytest.mark.parametrize("given, wanted", [("Composite Universal A1 20 capsules", {"A1", "20CAPSULES"}), ("Unifast III teinte A3,5 35 g", {"A3", "35G"}), ("Lime ISO 25 N° 3 21 mm", {"ISO25", "N°3", "21MM"}), ("L'intro pack", {"L"})])
def test_variant_tokens(spark, given, wanted):
    assert set(one(spark, given, tx.variant_tokens)) == wanted


def test_references(spark):
    assert one(spark, "ABC-123", tx.reference_value) == "ABC-123"
    assert one(spark, "Référence", tx.reference_value) == ""
    assert one(spark, " n/a ", tx.clean_reference) is None
    assert one(spark, "4867-A2", tx.normalize_reference) == "4867A2"
    assert one(spark, "3M ESPE", tx.normalize_brand) == "solventum"


@pytest.mark.parametrize("given, wanted", [("/produit-test.html", True), ("/customer/account.html", False), ("/catalogue/", False)])
def test_product_address(spark, given, wanted):
    assert one(spark, given, tx.product_address) is wanted


@pytest.mark.parametrize("given", ["Réf. GACD : 12345", "Réf GACD 12345", "Référence GACD: ABC-1"])
def test_marker(spark, given):
    assert len(one(spark, given, lambda c: extract.blocks(c, extract.marker("GACD", strict=False)))) == 1


def test_urls(spark):
    assert one(spark, "https://A.example/B%20c+d//", tx.canonical_url) == "https://a.example/b c+d"
    assert one(spark, "https://a.example/x.html?p=2&q=1#z", tx.page_url) == "https://a.example/x.html?p=2"
    assert one(spark, "https://a.example/c/gants-latex-A1.html", tx.title_from_slug) == "Gants Latex A1"


def test_similarity():
    assert token_set("a b c", "a b") == 1.0 and token_set("", "a") == 0.0
    assert token_set("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1.0
    assert round(token_set("composite universal a1 20 capsules", "composite universal a2 20 capsules"), 3) == 0.971


def _pair(spark, a, b):
    fields = ("name", "ean", "manufacturer_reference", "brand", "variant", "packaging")
    offers, products = (spark.createDataFrame([(1, *map(x.get, fields))], ", ".join([f"{key} long", *(f"{f} string" for f in fields)])) for key, x in (("offer_id", a), ("product_id", b)))
    return matching.scored_matches(offers, products).first()


def test_scores(spark):
    same = _pair(spark, {"name": "x", "brand": "3M", "manufacturer_reference": "4867-A2"}, {"name": "x", "brand": "Solventum", "manufacturer_reference": "4867A2"})
    assert (same.score, same.decision) == (0.99, "auto_match")
    assert _pair(spark, {"name": "x", "manufacturer_reference": "4867A1"}, {"name": "x", "manufacturer_reference": "4867A2"}).decision == "no_match"
    near = _pair(spark, {"name": "Composite Universal A1 20 capsules", "brand": "X"}, {"name": "Composite Universal A2 20 capsules", "brand": "X"})
    assert round(near.score, 3) == 0.983
    assert _pair(spark, {"name": "a", "ean": "1"}, {"name": "a", "ean": "2"}).score == 0.0


def test_categories(spark):
    rows = spark.createDataFrame([("Lime endodontique", ""), ("Inconnu", "Divers > X"), ("Inconnu", "")], "name string, crumbs string")
    assert [r.c for r in rows.select(classify.category("name", breadcrumb="crumbs").alias("c")).collect()] == ["Endodontie", "Divers", "Autres"]


def test_structured_data(spark):
    html = """<script type="application/ld+json">{"@type":"Product","name":"A","sku":"S1","brand":{"name":"B"},"offers":{"price":"12,50","availability":"https://schema.org/InStock"}}</script>
    <script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":"Product","name":"C","offers":{"price":3}}]}</script><script type="application/ld+json">broken</script>"""
    rows = extract.structured_products(spark.createDataFrame([(1, html)], "page_id long, html string"), "html", "page_id").orderBy("name").collect()
    assert [(r.name, r.price_eur, r.availability) for r in rows] == [("A", 12.5, "InStock"), ("C", 3.0, None)]
