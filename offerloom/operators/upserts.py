"""Whole ingests of a batch of offers: into a current table with its history, into a catalogue of canonical products, from refreshed pages.

A batch has ``seq``, the order in which its rows count. Rows find a stored row by tiers of keys; rows of a batch that find none
are the same new row if they share the key of the first tier that they have. Every step is a join or a window by that identity.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from offerloom.functions import text as tx
from offerloom.operators import matching
from offerloom.operators.dedup import tiered_key
from offerloom.operators.merge import changes, tiered_lookup
from offerloom.operators.ranking import first_wins, last_wins, numbered
from offerloom.plans.lineage import cut, cut_alone

CURRENT = "product_id long, merchant string, merchant_reference string, manufacturer_reference string, brand string, name string, variant string, source_url string, current_price_eur double, current_availability string, first_seen_at timestamp, last_seen_at timestamp"
HISTORY = "product_id long, observed_at timestamp, price_eur double, availability string, source string"
_TEXTS = ("merchant", "merchant_reference", "manufacturer_reference", "brand", "name", "variant", "source_url")
#: Columns of a stored merchant product that an ingest renews.
_RENEWED = ("manufacturer_reference", "ean", "name", "brand", "category", "variant", "packaging", "image_url", "availability")
MERCHANT_PRODUCT = "id long, product_id long, merchant string, merchant_reference string, url string, " + ", ".join(f"{c} string" for c in _RENEWED) + ", last_seen_at timestamp"
PRODUCT = "product_id long, name string, brand string, manufacturer_reference string, ean string"


class Upsert(NamedTuple):
    current: DataFrame
    history: DataFrame
    rejected: DataFrame


def _stripped(c: str) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit(""))


def _identified(rows: DataFrame, stored: DataFrame, tiers: list[list[str]], key: str, aside: tuple[str, ...]) -> DataFrame:
    """``rows`` without the columns ``aside``, with ``key`` (the stored id, or for new rows the next ids in order of ``seq``) and ``new``."""

    def identified() -> DataFrame:
        # both halves read what was looked up, so it is written once; it goes when they are written together
        found = cut(tiered_lookup(rows, stored, tiers, key, "seq").drop("found_tier").withColumnRenamed("found_id", key), "found")
        known, new = found.filter(F.col(key).isNotNull()), found.filter(F.col(key).isNull()).drop(key)
        new = new.withColumn("__key", tiered_key(tiers))
        firsts = new.groupBy("__key").agg(F.min("seq").alias("seq"))
        top = stored.agg(F.coalesce(F.max(key), F.lit(0)).alias("top"))
        ids = numbered(firsts, ["seq"], "__number").join(F.broadcast(top)).select("__key", (F.col("top") + F.col("__number")).cast("long").alias(key))  # one row
        both = known.withColumn("new", F.lit(False)).unionByName(new.join(ids, "__key").drop("__key").withColumn("new", F.lit(True)))
        return both.drop(*aside)

    return cut_alone(identified, "identified")


def daily_upsert(stored: DataFrame, batch: DataFrame, at: Column, source: str, strict: bool = True) -> Upsert:
    """The current table after a batch and the history rows that it adds.

    ``stored`` is as CURRENT, ``batch`` has seq, the texts, price_eur and availability. Rows are looked up by (merchant, merchant
    reference), else (merchant, maker's reference, address), else (merchant, address, name, variant); the smallest id counts. The
    last row of an identity gives the new values, ``first_seen_at`` stays. History gets each row whose price or availability
    differs from the row before, null being equal to null. ``strict`` strips all texts, rejects rows without merchant, name or
    address, and keeps the stored merchant reference; else only merchant, references and address are stripped, nothing is
    rejected, and the merchant reference is renewed.
    """
    stripped = _TEXTS if strict else ("merchant", "merchant_reference", "manufacturer_reference", "source_url")
    rows = batch.withColumns({c: _stripped(c) for c in stripped} | ({"availability": _stripped("availability")} if strict else {}))
    whole = F.col("merchant").isNotNull() & F.col("name").isNotNull() & F.col("source_url").isNotNull()
    rejected = rows.filter(~whole) if strict else rows.limit(0)
    rows = rows.filter(whole) if strict else rows
    filled = {f"__{c}": F.coalesce(F.col(c), F.lit("")) for c in ("merchant", "source_url", "name", "variant")}
    tiers = [["merchant_reference", "__merchant"], ["manufacturer_reference", "__merchant", "__source_url"], ["__tier", "__merchant", "__source_url", "__name", "__variant"]]
    keyed = lambda df: df.withColumns(filled).withColumn("__tier", F.lit("3"))
    # the last tier takes empty texts as values, so they are marked as set
    marked = lambda df: keyed(df).withColumns({k: F.concat(F.lit("="), F.col(k)) for k in filled})
    rows = _identified(marked(rows), marked(stored), tiers, "product_id", (*filled, "__tier"))
    # the reference of an identity's first row goes along with its last row: a join behind the full outer one would send all stored rows that the batch lacks to one task, under a null key
    first_reference = F.min_by(F.struct("merchant_reference"), "seq")["merchant_reference"].alias("__first")
    last = rows.groupBy("product_id").agg(F.max_by(F.struct(*_TEXTS, "price_eur", "availability"), "seq").alias("__row"), first_reference).select("product_id", "__row.*", "__first").alias("b")
    joined, old = stored.alias("c").join(last, F.col("c.product_id") == F.col("b.product_id"), "full_outer"), F.col("c.product_id").isNotNull()
    seen = F.col("b.product_id").isNotNull()
    pick = lambda c, new=None: F.when(seen, F.col(f"b.{new or c}")).otherwise(F.col(f"c.{c}")).alias(c)
    reference = F.when(old & F.lit(strict), F.col("c.merchant_reference")).when(seen, F.col("b.merchant_reference")).otherwise(F.col("c.merchant_reference"))
    reference = F.when(~old & F.lit(strict), F.col("b.__first")).otherwise(reference)
    current = joined.select(
        F.coalesce("c.product_id", "b.product_id").alias("product_id"), pick("merchant"), reference.alias("merchant_reference"), *[pick(c) for c in ("manufacturer_reference", "brand", "name", "variant", "source_url")],
        pick("current_price_eur", "price_eur"), pick("current_availability", "availability"), F.coalesce("c.first_seen_at", at).alias("first_seen_at"), F.when(seen, at).otherwise(F.col("c.last_seen_at")).alias("last_seen_at"),
    )
    before = stored.join(rows.select("product_id").distinct(), "product_id", "left_semi").select("product_id", F.lit(-1).cast("long").alias("seq"), F.col("current_price_eur").alias("price_eur"), F.col("current_availability").alias("availability"), F.lit(False).alias("live"))
    seen_rows = before.unionByName(rows.select("product_id", F.col("seq").cast("long").alias("seq"), F.col("price_eur").cast("double").alias("price_eur"), "availability", F.lit(True).alias("live")))
    history = changes(seen_rows, ["product_id"], ["seq"], ["price_eur", "availability"]).filter("live")
    return Upsert(current, history.select("product_id", at.alias("observed_at"), "price_eur", "availability", F.lit(source).alias("source")), rejected)


class Refresh(NamedTuple):
    rows: DataFrame
    missing: DataFrame


def refreshed(seed: DataFrame, parsed: DataFrame) -> Refresh:
    """Seed rows with price and availability of the parsed page, by (source_url, merchant_reference); the others are ``missing``.

    A maker's reference on the page replaces the seed's; everything else stays. ``parsed`` has one row per address and reference.
    """
    live = parsed.select("source_url", "merchant_reference", F.col("price_eur").alias("__price"), F.col("availability").alias("__stock"), F.col("manufacturer_reference").alias("__mfr"))
    keys = ["source_url", "merchant_reference"]
    rows = seed.withColumn("merchant_reference", F.trim("merchant_reference"))
    found = rows.join(live, keys).withColumns({"price_eur": F.col("__price"), "availability": F.col("__stock"), "manufacturer_reference": F.coalesce(tx.set_text("__mfr"), "manufacturer_reference")})
    return Refresh(found.drop("__price", "__stock", "__mfr"), rows.join(live, keys, "left_anti"))


class Catalogue(NamedTuple):
    merchant_products: DataFrame
    products: DataFrame
    offers: DataFrame
    review: DataFrame


def canonical_ingest(merchant_products: DataFrame, products: DataFrame, batch: DataFrame, at: Column) -> Catalogue:
    """Merchant products, canonical products, and the offers and review rows that a batch adds.

    ``batch`` has seq, merchant, merchant_reference, url, the renewed columns, price and currency. A row is looked up by (merchant, merchant
    reference), else (merchant, address, name): what is found is renewed and keeps its reference, address and product. What is new
    is matched with the products of earlier batches: an equal EAN or an unambiguous reference or an automatic score takes that
    product; else it becomes a product of its own, and a doubtful score a review row. New rows of one batch with an equal EAN, else
    an equal reference, share their new product. Every row adds an offer.
    """
    clean = {c: F.nullif(tx.normalize_reference(c), F.lit("")) for c in ("manufacturer_reference", "ean")}
    rows = batch.withColumns(clean | {"merchant_reference": tx.set_text("merchant_reference"), "__tier": F.lit("2")})
    tiers = [["merchant_reference", "merchant"], ["__tier", "merchant", "url", "name"]]
    rows = _identified(rows, merchant_products.withColumn("__tier", F.lit("2")), tiers, "id", ("__tier",))
    fresh = cut(first_wins(rows.filter("new"), ["id"], ["seq"]).withColumnRenamed("id", "offer_id"), "fresh")
    strong = matching.strong_matches(fresh, products)
    bare = products.withColumns({c: F.lit(None).cast("string") for c in ("variant", "packaging")})
    scored = cut(matching.sure_matches(fresh.join(strong, "offer_id", "left_anti"), bare), "scored")
    routes = cut(matching.route(fresh, strong, scored), "routes")
    unplaced = fresh.join(routes.filter("action <> 'reuse'"), "offer_id", "left_semi").withColumn("__key", tiered_key([["ean"], ["manufacturer_reference"], ["offer_id"]]))
    creators = first_wins(unplaced, ["__key"], ["seq"])
    top = products.agg(F.coalesce(F.max("product_id"), F.lit(0)).alias("top"))
    created = numbered(creators.select("__key", "seq", "name", "brand", "manufacturer_reference", "ean"), ["seq"], "__number").join(F.broadcast(top))  # one row
    created = cut(created.withColumn("product_id", (F.col("top") + F.col("__number")).cast("long")), "created")
    placed = routes.filter("action = 'reuse'").select("offer_id", "product_id").unionByName(unplaced.join(created.select("__key", "product_id"), "__key").select("offer_id", "product_id"))
    last = last_wins(rows, ["id"], ["seq"])
    kept = first_wins(rows.filter("new"), ["id"], ["seq"]).select("id", "merchant", "merchant_reference", "url").join(placed.withColumnRenamed("offer_id", "id"), "id")
    fixed = merchant_products.select("id", "product_id", "merchant", "merchant_reference", "url").unionByName(kept.select("id", "product_id", "merchant", "merchant_reference", "url"))
    stored = fixed.alias("f").join(merchant_products.alias("c"), F.col("f.id") == F.col("c.id"), "left").join(last.alias("b"), F.col("f.id") == F.col("b.id"), "left")
    seen = F.col("b.id").isNotNull()
    renewed = [F.when(seen, F.col(f"b.{c}")).otherwise(F.col(f"c.{c}")).alias(c) for c in _RENEWED]
    current = stored.select("f.*", *renewed, F.when(seen, at).otherwise(F.col("c.last_seen_at")).alias("last_seen_at"))
    offers = rows.select(F.col("id").alias("merchant_product_id"), F.col("price").cast("double").alias("price"), "currency", "availability", at.alias("scraped_at"), "seq")
    review = scored.filter("decision = 'review'").join(fresh.select("offer_id", "merchant", "merchant_reference"), "offer_id")
    review = review.select("merchant", "merchant_reference", F.col("product_id").alias("candidate_product_id"), F.round("score", 6).alias("score"), F.col("reason").alias("reasons"), at.alias("created_at"))
    return Catalogue(current, products.unionByName(created.select(*products.columns)), offers, review)
