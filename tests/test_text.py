"""Folding, entities, rounding and robots against the standard library."""

import html
import random
import re
import unicodedata

from pyspark.sql import functions as F

from offerloom.functions import text as tx
from offerloom.operators import publish


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string" if isinstance(values[0], str) else "i long, v double")
    return [r.x for r in df.select("i", f("v").alias("x")).orderBy("i").collect()]


def plain_fold(v):
    v = re.sub(r"\s+", " ", html.unescape(v).replace("\xa0", " ")).strip().lower()
    return re.sub(r"[^a-z0-9]+", " ", "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c))).strip()


def plain_key(v):
    v = unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", " ", v).strip()


def plain_front(v):
    return re.sub(r"[^a-z0-9]+", " ", re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", v.lower()))).strip()


def test_folds_equal_the_normal_forms_of_all_characters(spark):
    """Every assigned character between letters; Java's and Python's small letters may differ for newer scripts, which fold to a space either way."""
    chars = [chr(c) for c in range(0x20, 0x20000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co", "Cc") and chr(c) not in "&<"]
    values = [f"a{c}1" for c in chars]
    for f, plain in ((tx.fold, plain_fold), (tx.ascii_key, plain_key), (tx.front_fold, plain_front)):
        odd = [(hex(ord(c)), got, plain(v)) for c, v, got in zip(chars, values, column(spark, values, f)) if got != plain(v)]
        assert odd == [], (f.__name__, len(odd), odd[:20])


def test_folds_of_odd_texts(spark):
    assert column(spark, ["10㎜ A", "⅓ tasse", "①②", "Ａ１", "œuf ﬁn ½", "étẹ"], tx.fold) == ["10mm a", "1 3 tasse", "12", "a1", "uf fin 1 2", "ete"]
    assert column(spark, ["⅓ tasse", "½", "x² ﬁn", "É"], tx.front_fold) == ["tasse", "", "x n", "e"]
    assert column(spark, ["½ m²", "20 °C œ", None], tx.ascii_key)[:2] == ["12 m2", "20 c"]


def test_entities_equal_html(spark):
    texts = ["&check;", "&eacute", "&eacutes &notit; &notin;", "&amp;lt;", "& & &x; &unknown; &", "&#233; &#xE9 &#128; &#0; &#xD800; &#1; &#99999999999; &#x110000;", "&nbsp;&acE; &NotEqualTilde;", "a&copyb &ampamp; &AMP &Amp;", "&#65x &#x41g;", ""]
    rng = random.Random(1)
    names = list(html.entities.html5)
    texts += ["".join(rng.choice(["&" + rng.choice(names), "&" + rng.choice(names)[:4], ";", " ", "x", "&#", str(rng.randrange(400)), "&"]) for _ in range(12)) for _ in range(300)]
    odd = [(t, got, html.unescape(t)) for t, got in zip(texts, column(spark, texts, tx.unescape)) if got != html.unescape(t)]
    assert odd == [], odd[:5]


def test_cents_equal_round(spark):
    rng = random.Random(2)
    values = [2.675, 1.005, 0.125, 0.375, 2.5, 0.29, 0.005, 0.015, 1e-9, 1e12 + 0.005, 3e15, 1e300, 4.35, 1.115, 12.345, 0.285]
    values += [n / 200 for n in range(1, 4000)] + [n / 8 for n in range(1, 400)] + [rng.uniform(0, 10 ** rng.randrange(1, 12)) for _ in range(3000)] + [round(rng.uniform(0, 1000), 3) for _ in range(3000)]
    odd = [(v, got, round(v, 2)) for v, got in zip(values, column(spark, values, lambda c: tx.valid_price(F.col(c)))) if got != round(v, 2)]
    assert odd == [], odd[:5]
    assert column(spark, [float("nan"), float("inf"), -1.0, 0.0], lambda c: tx.valid_price(F.col(c))) == [None] * 4


def test_front_variants(spark):
    got = column(spark, ["Composite A3 250 mg, 10 ml N°25 ISO 30 XL xl"], tx.front_variants)[0]
    assert got == ["A3", "250 MG", "10 ML", "XL"]


def test_robots(spark):
    rows = [("User-agent: *\nDisallow: /cart", "https://a.example/cart/1", False), ("User-agent: *\nDisallow: /cart", "https://a.example/p", True), (None, "https://a.example/p", False), ("", "https://a.example/p", True), ("User-agent: own\nDisallow: /", "https://a.example/p", True), ("User-agent: *\nDisallow: /*?", None, False)]
    df = spark.createDataFrame(rows, "robots string, url string, want boolean")
    assert [r.got for r in df.select(publish.robots_allow("robots", "url").alias("got")).collect()] == [r[2] for r in rows]
    own = df.select(publish.robots_allow("robots", "url", "own").alias("got")).collect()
    assert own[4].got is False
