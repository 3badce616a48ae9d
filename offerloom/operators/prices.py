"""Comparison statistics and baskets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from offerloom.functions import text as tx
from offerloom.functions.text import is_set, js_round
from offerloom.operators.ranking import first_per_key, running, turn
from offerloom.plans.lineage import cut


def comparison(offers: DataFrame, product: str, merchant: str, price: str) -> DataFrame:
    """One row per product: number of offers, least and largest price, cheapest merchant (the first by name of equals)."""
    return offers.groupBy(product).agg(
        F.count(price).alias("n_offers"),
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
        F.min(F.struct(F.col(price).alias("p"), F.col(merchant).alias("m"))).getField("m").alias("cheapest_merchant"),
    )


def nested_export(offers: DataFrame, product: str, merchant: str, price: str, image: str | None = None) -> DataFrame:
    """A product's offers as an array sorted by price, then merchant; offers without price are left out of it.

    With ``image`` also the first image that is set, in the order of merchants.
    """
    listed = F.array_sort(F.collect_list(F.when(F.col(price).isNotNull(), F.struct(F.col(price).alias("value"), F.col(merchant).alias("merchant"))))).alias("prices")
    first = [F.min(F.when(is_set(image), F.struct(F.col(merchant).alias("m"), F.col(image).alias("i")))).getField("i").alias("image")] if image else []
    return offers.groupBy(product).agg(listed, *first)


def exact_medians(offers: DataFrame, product: str, price: str, parts: int = 64) -> DataFrame:
    """product, median_price, min_price, max_price, n_prices: exact, however many of all offers one product has.

    Equal prices of a product become one row with their number. Products and prices in one order are cut into ranges, so a product
    with very many prices lies in several; running numbers tell where the two middle ranks lie, and only those rows are gathered.
    Null prices are left out, products without any price have nulls.
    """
    known = offers.filter(F.col(price).isNotNull()).groupBy(F.col(product).alias("k"), F.col(price).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed = cut(running(known, ["k", "v"], {"before": "n"}, parts, "part"), "placed")
    # what a range holds of a product; together they tell where the product begins and how many prices it has
    held = placed.groupBy("part", "k").agg(F.min("before").alias("start"), F.sum("n").alias("n_prices"), F.min("v").alias("low"), F.max("v").alias("high"))
    whole = held.groupBy("k").agg(F.min("start").alias("start"), F.sum("n_prices").alias("n_prices"), F.min("low").alias("min_price"), F.max("high").alias("max_price"))
    spans = held.select("part", F.col("k").alias("__k")).join(whole, F.col("__k").eqNullSafe(F.col("k"))).drop("k")
    rows = placed.join(spans, (placed["part"] == spans["part"]) & placed["k"].eqNullSafe(F.col("__k")))
    rank = lambda r: (F.col("start") + r >= F.col("before")) & (F.col("start") + r < F.col("before") + F.col("n"))
    lower, upper = rank(F.floor((F.col("n_prices") - 1) / 2)), rank(F.floor(F.col("n_prices") / 2))
    middle = rows.filter(lower | upper).groupBy("k").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.first("n_prices").alias("n_prices"), F.first("min_price").alias("min_price"), F.first("max_price").alias("max_price"))
    middle = middle.select(F.col("k").alias("__k"), ((F.col("a") + F.col("b")) / 2).alias("median_price"), "min_price", "max_price", "n_prices")
    out = offers.select(product).distinct().join(middle, F.col(product).eqNullSafe(F.col("__k")), "left").drop("__k")
    return out.withColumn("n_prices", F.coalesce("n_prices", F.lit(0)))


def median_savings(offers: DataFrame, product: str, price: str) -> DataFrame:
    """Exact median of a product's prices and the saving of the cheapest against it in whole per cent."""
    out = exact_medians(offers, product, price).select(product, "median_price", "min_price")
    saving = F.when(F.col("median_price") > 0, js_round((F.col("median_price") - F.col("min_price")) / F.col("median_price") * 100)).otherwise(0)
    return out.withColumn("saving_percent", saving.cast("long"))


def bar_widths(ranked: DataFrame, product: str, price: str, least: float = 18.0) -> DataFrame:
    """Width of an offer's bar in per cent of the product's dearest, not below ``least``."""
    dearest = ranked.groupBy(product).agg(F.max(price).alias("__max"))
    return ranked.join(dearest, product).withColumn("bar_percent", F.greatest(F.lit(least), 100 * F.col(price) / F.col("__max"))).drop("__max")


def offer_savings(offers: DataFrame, product: str, price: str) -> DataFrame:
    """Each offer against its product: saving_percent (of the median, whole per cent) and bar_percent (of the dearest, 100 at most)."""
    offers = cut(offers, "offers")  # read three times
    sums = exact_medians(offers, product, price).select(product, "median_price", F.col("max_price").alias("__max"))
    saving = F.when(F.col("median_price") > 0, js_round((F.col("median_price") - F.col(price)) / F.col("median_price") * 100)).otherwise(0)
    bar = F.when(F.col("__max") > 0, F.least(F.lit(100.0), 100 * F.col(price) / F.col("__max"))).otherwise(0.0)
    return offers.join(sums, product).withColumns({"saving_percent": saving.cast("long"), "bar_percent": bar}).drop("__max")


def _covered(rows: DataFrame, prices: DataFrame, basket: str, item: str, merchant: str, price: str, quantity: str) -> DataFrame:
    """basket, merchant, covered, n_items, total of rows that name a basket's item and a merchant; what the merchant doesn't have is left out."""
    offered = prices.select(F.col(item).alias("__item"), F.col(merchant).alias("__merchant"), F.col(price).alias("__price"))
    priced = rows.join(offered, (F.col(item) == F.col("__item")) & F.col(merchant).eqNullSafe(F.col("__merchant"))).groupBy(basket, merchant)
    return priced.agg(F.count(F.lit(1)).alias("covered"), F.first("n_items").alias("n_items"), F.sum(F.col("__price") * F.col(quantity)).alias("total"))


def full_baskets(items: DataFrame, prices: DataFrame, basket: str, item: str, merchant: str, price: str, quantity: str) -> DataFrame:
    """The merchants that have all items of a basket: basket, merchant, n_items, total.

    ``items`` has a row per basket and item, ``prices`` one per item and merchant. Such a merchant has the item with the fewest offers and the
    one with the next fewest, so only merchants that have these two are looked up for all items; a basket of one item is settled by its offers.
    """
    held = prices.groupBy(item).agg(F.count(F.lit(1)).alias("__held"))
    each = W.partitionBy(basket)
    ranked = each.orderBy("__held", item)
    sized = items.join(held, item, "left").withColumns({"n_items": F.count(F.lit(1)).over(each), "__unheld": F.count_if(F.col("__held").isNull()).over(each), "__turn": F.row_number().over(ranked), "__next": F.lead(item).over(ranked)})
    rarest = sized.filter("__turn = 1 and __unheld = 0").select(basket, item, quantity, "n_items", "__next").join(prices.select(item, merchant, price), item)
    alone = rarest.filter("n_items = 1").select(basket, merchant, "n_items", (F.col(price) * F.col(quantity)).alias("total"))
    other = prices.select(F.col(item).alias("__i"), F.col(merchant).alias("__m"))
    both = rarest.filter("n_items > 1").select(F.col(basket).alias("__basket"), merchant, "__next")
    both = both.join(other, (F.col("__next") == F.col("__i")) & F.col(merchant).eqNullSafe(F.col("__m")), "left_semi")
    wanted = items.withColumn("n_items", F.count(F.lit(1)).over(each)).join(both, F.col(basket).eqNullSafe(F.col("__basket")))
    found = _covered(wanted.select(basket, item, quantity, "n_items", merchant), prices, basket, item, merchant, price, quantity)
    return alone.unionByName(found.filter("covered = n_items").drop("covered"))


def best_partial(items: DataFrame, prices: DataFrame, basket: str, item: str, merchant: str, price: str, quantity: str, shown: Callable[[Column], Column], most: int = 5) -> DataFrame:
    """The merchants that cover most of a basket, the cheaper of equals first, then by merchant: basket, merchant, covered, n_items, total, place.

    Tables are as in ``full_baskets``; totals count as ``shown``. An item goes to its basket in one row, with the list of its merchants and its ``most`` cheapest
    offers. In the basket's row stand the merchants of several items, and of those of one item no more than places are left can count. What these have is then priced.
    """
    listed = prices.groupBy(item).agg(F.array_sort(F.collect_list(F.struct(F.col(merchant).alias("m"), F.col(price).alias("p")))).alias("__offers"))
    cheap = F.slice(F.array_sort(F.transform("__offers", lambda o: F.struct(shown(o["p"] * F.col(quantity)).alias("total"), o["m"].alias("m")))), 1, most)
    told = F.struct(F.col(item).alias("item"), F.col(quantity).alias("qty"), F.coalesce(F.col("__offers.m"), F.array()).alias("merchants"), F.coalesce(cheap, F.array()).alias("cheap"))
    baskets = items.join(listed, item, "left").select(basket, told.alias("__item")).repartition(basket).groupBy(basket).agg(F.count(F.lit(1)).alias("n_items"), F.collect_list("__item").alias("__items"))
    in_order = F.array_sort(F.flatten(F.col("__items.merchants")))
    several = tx.bound(in_order, lambda ms: F.array_distinct(F.filter(ms, lambda m, i: (i > 0) & m.eqNullSafe(F.get(ms, i - 1)))))
    row = lambda m, r: F.struct(m.alias("m"), r["item"].alias("item"), r["qty"].alias("qty"))
    of_several = F.flatten(F.transform("__several", lambda m: F.transform(F.filter("__items", lambda r: F.coalesce(F.array_contains(r["merchants"], m), m.isNull())), lambda r: row(m, r))))
    once = F.flatten(F.transform("__items", lambda r: F.transform(r["cheap"], lambda c: F.struct(c["total"].alias("total"), c["m"].alias("m"), r["item"].alias("item"), r["qty"].alias("qty")))))
    once = F.slice(F.array_sort(F.filter(once, lambda c: ~F.exists("__several", lambda m: m.eqNullSafe(c["m"])))), F.lit(1), F.greatest(F.lit(most) - F.size("__several"), F.lit(0)))
    rows = baskets.withColumn("__several", several).select(basket, "n_items", F.inline(F.concat(of_several, F.transform(once, lambda c: row(c["m"], c)))))
    rows = rows.select(basket, "n_items", F.col("m").alias(merchant), F.col("item").alias(item), F.col("qty").alias(quantity))
    found = _covered(rows, prices, basket, item, merchant, price, quantity).withColumn("total", shown(F.col("total")))
    return found.withColumn("place", turn(found, [basket], [F.desc("covered"), F.asc("total"), F.asc(merchant)])).filter(F.col("place") <= most)


def cheapest_split(items: DataFrame, prices: DataFrame, basket: str, item: str, merchant: str, price: str, quantity: str) -> DataFrame:
    """Each item at its cheapest merchant: per basket and merchant the number of items and the subtotal."""
    cheapest = first_per_key(prices, [item], [F.asc(price), F.asc(merchant)])
    return items.join(cheapest, item).groupBy(basket, merchant).agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.col(price) * F.col(quantity)).alias("subtotal"))


def split_totals(split: DataFrame, basket: str) -> DataFrame:
    """Per basket of ``cheapest_split``: the number of merchants, of items, and the grand total."""
    return split.groupBy(basket).agg(F.count(F.lit(1)).alias("n_merchants"), F.sum("n_items").alias("n_items"), F.sum("subtotal").alias("total"))


def cart(events: DataFrame, keys: Sequence[str], action: str, value: str, seq: str) -> DataFrame:
    """The quantity of each item in its cart after all events; items that were removed are not listed.

    Actions are add (one more, or a new item), set (the quantity to ``value``, one at least, if the item is there) and remove. What
    counts are the events after the last removal: of these the last set behind the first add, and the adds behind it.
    """
    removed = events.filter(F.col(action) == "remove").groupBy(*keys).agg(F.max(seq).alias("__removed"))
    live = events.filter(F.col(action).isin("add", "set")).join(removed, list(keys), "left").filter(F.col("__removed").isNull() | (F.col(seq) > F.col("__removed")))
    added = live.filter(F.col(action) == "add").groupBy(*keys).agg(F.min(seq).alias("__added"))
    live = live.join(added, list(keys)).filter(F.col(seq) >= F.col("__added"))
    placed = live.filter(F.col(action) == "set").groupBy(*keys).agg(F.max(F.struct(F.col(seq).alias("at"), F.greatest(F.lit(1), F.col(value)).alias("qty"))).alias("__set"))
    adds = live.filter(F.col(action) == "add").join(placed, list(keys), "left").groupBy(*keys)
    out = adds.agg(F.count_if(F.col("__set").isNull() | (F.col(seq) > F.col("__set.at"))).alias("more"), F.first("__set.qty").alias("base"))
    return out.select(*keys, (F.col("more") + F.coalesce("base", F.lit(0))).cast("long").alias("qty"))
