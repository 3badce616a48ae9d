"""From captured rows to a published catalogue: usable offers, canonical ids, images, titles, crawl permissions."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from offerloom.functions import text as tx
from offerloom.operators.classify import BASE_DEFAULT, BASE_RULES, by_pattern
from offerloom.operators.ranking import numbered


def usable(name: Column, price: Column, image: Column, url: Column) -> Column:
    """A name, a finite price above zero, an image and an address."""
    return tx.is_set(name) & tx.valid_price(price).isNotNull() & tx.is_set(image) & tx.is_set(url)


def published(offers: DataFrame, merchant: str) -> DataFrame:
    """The usable offers under their published names: fallbacks for price, image and address, prices with two decimals."""
    rows = offers.select(
        F.coalesce(tx.set_text("merchant"), F.lit(merchant)).alias("merchant"),
        F.trim("name").alias("name"),
        F.trim(F.coalesce("brand", F.lit(""))).alias("brand"),
        tx.valid_price(F.coalesce("price_eur", "price")).alias("price_eur"),
        F.coalesce(tx.set_text("image_url"), tx.set_text("image")).alias("image_url"),
        F.coalesce(tx.set_text("source_url"), tx.set_text("url")).alias("source_url"),
    )
    return rows.filter(usable(F.col("name"), F.col("price_eur"), F.col("image_url"), F.col("source_url")))


def with_ids(df: DataFrame, prefix: str, order: list[str], column: str = "id", parts: int = 64) -> DataFrame:
    """Dense ids prefix-1, prefix-2, ... in the given order."""
    return numbered(df, order, column, parts).withColumn(column, F.concat(F.lit(f"{prefix}-"), F.col(column)))


def image_for(reference: Column, images: Column, default: Column | None = None) -> Column:
    """The first image whose address holds the reference, else the default, else the first."""
    hit = F.filter(images, lambda i: F.contains(F.lower(i), F.lower(reference)))
    return F.coalesce(F.try_element_at(hit, F.lit(1)), *([default] if default is not None else []), F.try_element_at(images, F.lit(1)))


def cleaned_title(name: Column | str, brand: Column | str, reference: Column | str) -> Column:
    """The name without reference, price and brand at its end."""
    out = F.replace(tx.clean(name), F.coalesce(tx.set_text(reference), F.lit("\x00")), F.lit(""))
    out = F.regexp_replace(out, r"\s*(?:à partir de\s*)?\d+(?:[.,]\d{1,2})?\s*(?:€|EUR).*$", "")
    brand_text = F.coalesce(tx.set_text(brand), F.lit("\x00"))
    tail = F.when(F.endswith(F.lower(F.trim(out)), F.lower(brand_text)), F.left(F.trim(out), F.length(F.trim(out)) - F.length(brand_text))).otherwise(out)
    return F.regexp_replace(F.trim(tail), r"[\s\-–|,:]+$", "")


def category_seeds(links: DataFrame, url: str, host: str, denied: str = r"(?i)(customer|cart|checkout|login|search|contact)") -> DataFrame:
    """Distinct category addresses of a host: .html pages two parts deep or more, without query."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    path = F.try_parse_url(bare, F.lit("PATH"))
    ok = (F.try_parse_url(bare, F.lit("HOST")) == host) & path.rlike(r"\.html$") & ~path.rlike(denied) & (F.size(F.filter(F.split(path, "/"), lambda p: p != "")) >= 2)
    return links.filter(ok).select(bare.alias("url")).distinct()


#: The front end's labels of its categories.
FRONT_LABELS = {"anesthesie": "Anesthésie", "empreintes": "Empreintes", "rotatifs": "Instruments rotatifs", "endodontie": "Endodontie", "hygiene": "Hygiène & stérilisation", "usage-unique": "Usage unique"}


def front_category(detail: Column, name: Column) -> Column:
    """key, label, detail: the front end's category of an offer by its own category and its name; detail is the former, empty if there is none."""
    own = F.trim(F.coalesce(detail, F.lit("")))
    key = by_pattern(tx.front_fold(F.concat_ws(" ", own, F.coalesce(name, F.lit("")))), BASE_RULES, BASE_DEFAULT)
    label = lambda k: F.element_at(F.create_map(*[F.lit(x) for pair in FRONT_LABELS.items() for x in pair]), k)
    return tx.bound(key, lambda k: F.struct(k.alias("key"), label(k).alias("label"), own.alias("detail")))


def split_by_completeness(rows: DataFrame, needed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all needed columns set, and the others as errors with what they lack."""
    lacking = F.array_compact(F.array(*[F.when(~tx.is_set(c), F.lit(c)) for c in needed]))
    marked = rows.withColumn("lacking", lacking)
    return marked.filter(F.size("lacking") == 0).drop("lacking"), marked.filter(F.size("lacking") > 0)


def robots_allow(text: Column | str, url: Column | str, agent: str = "*") -> Column:
    """Whether a captured robots text lets ``agent`` fetch the address. A text that could not be had (null) allows nothing, an empty one all."""

    @F.pandas_udf(T.BooleanType())
    def allowed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, RobotFileParser] = {}
        for texts, urls in batches:
            out = []
            for told, address in zip(texts, urls):
                if told is None or address is None:
                    out.append(False)
                    continue
                if told not in known:
                    known.clear() if len(known) > 1000 else None
                    known[told] = RobotFileParser()
                    known[told].parse(told.splitlines())
                out.append(known[told].can_fetch(agent, address))
            yield pd.Series(out, dtype=bool)

    return allowed(text, url)
