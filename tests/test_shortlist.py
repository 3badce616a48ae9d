"""The best of a list of products: equal to scoring all of them, and fast where bounds part little."""

import hashlib
import random
import time

from pyspark.sql import functions as F

from offerloom.functions.similarity import token_set
from offerloom.operators import matching, upserts
from offerloom.operators.shortlist import APART, BRAND, NAME, PACK, Shortlist


def _row(i, name, brand="", pack="", variants=()):
    return {"product_id": i, "ean": "", "ref": "", "brand": brand, "name": name, "pack": pack, "variants": list(variants)}


def _all_scored(products, offer):
    def value(p):
        brand = 0.5 if not (p["brand"] and offer["brand"]) else float(p["brand"] == offer["brand"])
        pack = 0.5 if not (p["pack"] and offer["pack"]) else token_set(offer["pack"], p["pack"])
        apart = p["variants"] and offer["variants"] and not set(p["variants"]) & set(offer["variants"])
        names = token_set(offer["name"], p["name"]) if offer["name"] and p["name"] else 0.0
        return max(0.0, min(1.0, NAME * names + BRAND * brand + PACK * pack - (APART if apart else 0.0)))

    return max((value(p), p["product_id"]) for p in products)


def test_equals_scoring_all():
    rng = random.Random(5)
    words = ["gants", "boîte", "é", "lime 25", "k3", "x" * 70, "bleu", "n1", ""]
    name = lambda i: rng.choice([" ".join(rng.choices(words, k=rng.choice((1, 2, 5)))).strip(), hashlib.md5(str(i).encode()).hexdigest(), hashlib.sha512(str(i).encode()).hexdigest()])
    row = lambda i: _row(i, name(i), rng.choice(["", "a", "b"]), rng.choice(["", "lot de 5", "boite 10"]), rng.choice([[], ["A1"], ["A2"]]))
    products = [row(i) for i in range(250)]
    known = Shortlist(products)
    for i in range(1000, 1120):
        offer = row(i)
        value, best = _all_scored(products, offer)
        assert known.best(offer)[:2] == (best, value)


def test_names_of_random_letters_are_compared_many_at_a_time():
    known = Shortlist([_row(i, "x" + hashlib.sha1(str(i).encode()).hexdigest()) for i in range(3000)])
    began = time.perf_counter()
    for i in range(100):
        assert known.best(_row(i, "zz" + hashlib.md5(str(i).encode()).hexdigest()))[3] > 100
    assert time.perf_counter() - began < 2


def _side(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, name string, ean string, manufacturer_reference string, brand string, variant string, packaging string")


def test_sure_matches_equal_the_best_of_all(spark, monkeypatch):
    """Identifiers, brands, packagings and variants in play, dealt in small pieces: what ``scored_matches`` finds among all products, where it is sure."""
    monkeypatch.setattr(matching, "_PRODUCTS_AT_ONCE", 40)
    monkeypatch.setattr(matching, "_OFFERS_AT_ONCE", 60)
    rng = random.Random(0)
    words, pick = "gants latex limes gutta cement ciment fraise masque".split(), lambda *xs: rng.choice(xs)

    def row(i):
        name = pick(" ".join(rng.sample(words, rng.choice((1, 2, 3)))), "x" + hashlib.md5(str(i % 40).encode()).hexdigest()[: pick(30, 31)], "", None)
        return (i, name, pick("", None, "", "12345678", "87654321"), pick("", "", "R-100", "r100", "R200"), pick("", "Acme", "3M", "Solventum", None), pick("", "A1", "A2"), pick("", "boite de 10", "boite de 100", "lot x"))

    offers, products = _side(spark, [row(i) for i in range(300)], "offer_id"), _side(spark, [row(i) for i in range(240)], "product_id")
    want = {(r.offer_id, r.product_id, r.score, r.reason, r.decision) for r in matching.scored_matches(offers, products).collect() if r.score >= matching.REVIEW}
    got = [tuple(r) for r in matching.sure_matches(offers, products).select("offer_id", "product_id", "score", "reason", "decision").collect()]
    assert set(got) == want and len(got) == len(want) > 20
    assert matching.sure_matches(offers, products.limit(0)).count() == 0 == matching.sure_matches(offers.limit(0), products).count()


def test_products_before_the_newest_count(spark):
    """The match of an offer is found whatever number of newer products there is: by routes, and by a whole ingest."""
    at = F.lit("2024-01-01").cast("timestamp")
    stored = [(1, "composite universel teinte claire", "Acme", None, None)] + [(i, f"article {i}", "Acme", None, None) for i in range(2, 3500)]
    offer = [(1, "m", "a", "u", "composite universel teinte claire", "Acme")]
    products = spark.createDataFrame(stored, upserts.PRODUCT)
    batch = spark.createDataFrame(offer, "seq long, merchant string, merchant_reference string, url string, name string, brand string")
    batch = batch.withColumns({c: F.lit(None).cast("string") for c in ("manufacturer_reference", "ean", "category", "variant", "packaging", "image_url", "availability", "currency")} | {"price": F.lit(1.0)})
    done = upserts.canonical_ingest(spark.createDataFrame([], upserts.MERCHANT_PRODUCT), products, batch, at)
    assert [r.candidate_product_id for r in done.review.collect()] == [1]
