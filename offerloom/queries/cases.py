"""Odd inputs of the normalising functions, dealt over the parts; the SQL states what each must become."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from offerloom.functions import text as tx
from offerloom.operators import extract, publish
from offerloom.queries.views import table

_S = "https://www.shop.example"
#: Name: the columns that the function makes of ``x``, and inputs with what they become, in the order of the columns.
CASES: dict[str, tuple[dict[str, Callable[[Column], Column]], list[tuple]]] = {
    "slug_titles": ({"title": lambda x: tx.title_from_slug(x, "Produit"), "reference": tx.reference_from_url}, [
        (f"{_S}/c/gants-iPhone-latex-12-345.html", "Gants IPhone Latex", "12-345"), (f"{_S}/c/fraise-FG-diamant.html?x=1", "Fraise FG Diamant", None), (f"{_S}/%C3%A9tui_rouge.HTML", "Étui Rouge", None), (f"{_S}/c/", "C", None),
        (f"{_S}/", "Produit", None), (f"{_S}/lot-1-2.html", "Lot 1 2", None), (f"{_S}/a-1234-56.html", "A", "1234-56"), (f"{_S}/a-123456-12.html", "A 123456 12", None), (f"{_S}/a+b-99-100.html#z", "A+b", "99-100"),
    ]),
    "product_addresses": ({"archived": tx.product_address, "under": lambda x: tx.product_address_under(x, f"{_S}/"), "of_host": lambda x: tx.product_address_of(x, ("www.shop.example", "shop.example")), "category": tx.category_address, "candidate": tx.page_candidate}, [
        (f"{_S}/article-77", True, True, False, False, False), (f"{_S}/media/a.html", False, False, False, True, True), (f"{_S}/a.HTML", True, True, True, True, True), (f"{_S}/a.html?x=1", False, True, True, False, True),
        (f"{_S}/faq/a.html", False, True, True, True, True), (f"{_S}/c/?p=2", False, True, False, True, False), (f"{_S}/customer/a.html", False, True, False, True, False), ("https://shop.example/b.html", True, False, True, True, True),
        ("https://other.example/b.html", True, False, False, True, True), (f"{_S}/sitemap.xml", False, False, False, False, False), (f"{_S}/marques/x.html", True, True, False, False, True), (f"{_S}/article-77-x.html", True, True, True, False, True),
        (f"{_S}/catalogue/", False, True, False, True, False), (None, False, False, False, False, False),
    ]),
    "site_addresses": ({"kept": lambda x: tx.site_address(x, "www.shop.example"), "key": tx.canonical_url}, [
        (f"{_S}/a.html?utm=1", f"{_S}/a.html?utm=1", f"{_S}/a.html?utm=1"), (f"{_S}/cart", "", f"{_S}/cart"), (f"{_S}/cartes.html", f"{_S}/cartes.html", f"{_S}/cartes.html"), ("ftp://www.shop.example/a", "", "ftp://www.shop.example/a"),
        ("https://WWW.shop.example/A%20b//", "https://WWW.shop.example/A%20b//", f"{_S}/a b"), ("https://x.example/a", "", "https://x.example/a"), (None, "", ""),
    ]),
    "price_forms": ({form: (lambda x, form=form: tx.price_by(x, form)) for form in ("thousands", "page", "listing", "spaced", "last", "net", "family")} | {"bare": tx.bare_price, "number": tx.number}, [
        ("12,50 €", 12.5, 12.5, 12.5, 12.5, 12.5, None, 12.5, 12.5, None), ("12.50 €", 1250.0, 1250.0, 12.5, 12.5, 12.5, None, 12.5, 12.5, None), ("1 234,50 €", 1234.5, 1234.5, 1234.5, 1234.5, 1234.5, None, 1234.5, 1234.5, None),
        ("1.234,50 € HT", 1234.5, 1234.5, 234.5, 234.5, 234.5, 234.5, 234.5, 1.23, None), ("7 €", None, None, 7.0, None, None, None, None, 7.0, None), ("avant 9,00 € puis 8,00 €", 9.0, 9.0, 9.0, 9.0, 8.0, None, 9.0, 9.0, None),
        ("10,00 € TTC 8,33 € ht", 10.0, 10.0, 10.0, 10.0, 8.33, 8.33, 10.0, 10.0, None), (" 36,1 ", None, None, None, None, None, None, None, 36.1, 36.1), ("gratuit", None, None, None, None, None, None, None, None, None), (None, *[None] * 9),
    ]),
    "reference_validators": ({"prepared": tx.clean_reference, "enriched": tx.enriched_reference, "published": tx.header_reference, "marked": tx.marked_reference, "page": tx.page_reference, "mfr": tx.manufacturer_key, "ean": tx.ean}, [
        (" n/a ", None, None, "n/a", "n/a", None, None, None), ("Non renseigné", "Non renseigné", None, "Non renseigné", "", None, "NONRENSEIGN", None), ("ABC-123", "ABC-123", "ABC-123", "ABC-123", "ABC-123", "ABC-123", "ABC123", None),
        ("Référence", "Référence", "Référence", "Référence", "", "Référence", "RFRENCE", None), ("(R-55/2).", "(R-55/2).", "(R-55/2).", "(R-55/2).", "R-55/2", "(R-55/2).", "R552", None), ("reference", "reference", "reference", None, "", "reference", None, None),
        ("3401 5602-1", "3401 5602-1", "3401 5602-1", "3401 5602-1", "", "3401 5602-1", "340156021", "340156021"), ("x{y}", "x{y}", "x{y}", "x{y}", "", None, None, None), ("var f=function()", "var f=function()", "var f=function()", "var f=function()", "", None, "VARFFUNCTION", None),
        ("A" * 70, "A" * 70, "A" * 70, "A" * 70, "", None, "A" * 70, None), ("B" * 90, "B" * 90, None, "B" * 90, "", None, "B" * 90, None), ("  ", None, None, None, "", None, None, None), (None, None, None, None, "", None, None, None),
    ]),
    "entities": ({"clean": tx.clean, "fold": tx.fold}, [
        ("m&ecirc;me &#8217; fa&ccedil;on", "même ’ façon", "meme facon"), ("a&nbsp;&nbsp;b", "a b", "a b"), ("&amp;eacute;", "&eacute;", "eacute"), ("5 &euro; &#x20AC; &#146;", "5 € € ’", "5"), ("&bogus; & ;", "&bogus; & ;", "bogus"),
        ("&oelig;uvre &frac12;", "œuvre ½", "uvre 1 2"), ("R&D", "R&D", "r d"), ("&lt;b&gt; &#128512;", "<b> 😀", "b"), (None, "", ""),
    ]),
    "stock_states": ({"kept": tx.normalize_stock, "mended": lambda x: tx.normalize_stock(x, False)}, [
        ("Disponible sous 3 jours", "in_stock", "in_stock"), ("INDISPONIBLE", "in_stock", "discontinued"), ("En réapprovisionnement Disponible sous 3 jours", "in_stock", "backorder"), ("Sur commande", "on_order", "on_order"), ("Rupture", "backorder", "backorder"),
        ("Arr&ecirc;t&eacute;", "discontinued", "discontinued"), ("https://schema.org/InStock", "unknown", "unknown"), ("", None, None), (None, None, None),
    ]),
    "packaging_hints": ({"packaging": tx.extract_packaging}, [
        ("Boîte de 100 gants", "boite de 100 100 gants"), ("10 x 5 g poudre", "10 5 g"), ("10 × 5 g", "5 g"), ("Flacon 1,5 ml", "5 ml"), ("Coffret de 6 limes 21 mm", "coffret de 6 6 limes"), ("rien", ""), (None, ""),
    ]),
    "variant_marks": ({"tokens": lambda x: F.array_join(tx.variant_tokens(x), ",")}, [
        ("Composite A1 20 capsules", "20CAPSULES,A1"), ("teinte A3,5 35 g", "35G,A3"), ("Lime ISO 25 N° 3 21 mm", "21MM,ISO25,N°3"), ("xl gants A1 a1", "A1,XL"), ("A3.5 2,5 ml", "2,5ML,A3.5"), ("rien", ""), (None, ""),
    ]),
    "brand_aliases": ({"brand": tx.normalize_brand, "group_brand": tx.group_brand}, [
        ("3M ESPE", "solventum", "solventum"), ("Dentsply", "dentsply sirona", "dentsplysirona"), (" Micro  Mega", "micro-mega", "micromega"), ("Micro-Mega", "micro-mega", "micromega"), ("3m", "solventum", "solventum"), ("Kerr 2", "kerr 2", "kerr"), ("Été & Fils", "ete fils", "etefils"), (None, "", ""),
    ]),
    "titles_cleaned": ({"title": lambda x: publish.cleaned_title(x, F.lit("Acme"), F.lit("R-12"))}, [
        ("Gants R-12 Acme", "Gants"), ("Gants latex  à partir de 12,50 € la boîte", "Gants latex"), ("Acme gants", "Acme gants"), ("Limes 25 mm - Acme", "Limes 25 mm"), ("Ciment 9,90 EUR", "Ciment"), ("Gants", "Gants"), (None, ""),
    ]),
    "challenges": ({"challenged": extract.challenged, "refused": lambda x: extract.challenged(x, F.lit(403))}, [
        ("<title>Just a moment...</title><body>x</body>", True, True), ("<title>Gants</title><body><script src='recaptcha.js'></script><p>Gants</p></body>", False, True), ("<body><p>Verify you are human</p></body>", True, True),
        ("<title>Just a moment</title><h1>Gants</h1><div class='price-box'>5 €</div>", False, True), ("<body>Nos clients: verify you are human</body>", False, True), ("<title> Attention  required </title>", True, True), (None, False, True),
    ]),
}


def _query(name: str):
    columns, cases = CASES[name]

    def run(spark, d):
        inputs = F.lit([c[0] if c[0] is not None else "\x00" for c in cases])
        x = F.nullif(F.element_at(inputs, (F.col("p_partkey") % len(cases) + 1).cast("int")), F.lit("\x00"))
        return table(spark, d, "part").select("p_partkey", x.alias("x")).select("p_partkey", *[make(F.col("x")).alias(c) for c, make in columns.items()])

    return run


def _value(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else "'" + v.replace("'", "''") + "'"


def _sql(name: str) -> str:
    columns, cases = CASES[name]
    out = [f"CASE p_partkey % {len(cases)} " + " ".join(f"WHEN {i} THEN {_value(c[k + 1])}" for i, c in enumerate(cases)) + f" END AS {column}" for k, column in enumerate(columns)]
    return f"SELECT p_partkey, {', '.join(out)} FROM part"


QUERIES = {name: _query(name) for name in CASES}
ORACLES = {name: _sql(name) for name in CASES}
