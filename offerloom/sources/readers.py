"""Readers of captured catalogues. Every schema is stated, so references keep their leading zeros."""

from __future__ import annotations

import gzip
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from offerloom.functions import text as tx
from offerloom.operators import frontier

SEED = "merchant string, brand string, name string, merchant_reference string, manufacturer_reference string, variant string, price_eur string, availability string, source_url string"
_OFFER_FIELDS = ("merchant", "source_url", "url", "name", "merchant_reference", "manufacturer_reference", "ean", "brand", "category", "variant", "packaging", "price_eur", "price", "availability", "image_url", "image", "captured_at")
_OFFER = "struct<" + ",".join(f"{f}:string" for f in _OFFER_FIELDS) + ">"
CAPTURE = f"source string, merchant string, captured_at string, products array<{_OFFER}>, items array<{_OFFER}>, offers array<{_OFFER}>, " + ", ".join(f"{f} string" for f in _OFFER_FIELDS if f not in ("merchant", "captured_at"))


def seed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A seed list with header; a byte-order mark is skipped."""
    return spark.read.csv(path, schema=SEED, header=True, quote='"', escape='"').withColumn("price_eur", tx.parse_price("price_eur"))


def seed_addresses(seed: DataFrame) -> DataFrame:
    """The addresses of a seed list with the number of their rows, so that a page is fetched once for all of them."""
    return seed.filter(tx.is_set("source_url")).groupBy("source_url").agg(F.count(F.lit(1)).alias("n_rows"))


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Offers of capture files: an object with products, items or offers, or a list of offers; a file's header fills missing fields.

    Files are found in subfolders as well, also compressed ones. Broken files give no rows and stop nothing.
    """
    raw = spark.read.schema(CAPTURE + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).json(path)
    raw = raw.withColumn("file", F.input_file_name())
    rows = F.coalesce("products", "items", "offers", F.array(F.struct(*_OFFER_FIELDS)))
    out = raw.select("file", F.col("merchant").alias("__m"), F.col("captured_at").alias("__c"), F.posexplode(rows).alias("position", "o"))
    return out.select("file", "position", *normalised_offer("o", F.col("__m"), F.col("__c"))).filter(tx.is_set("name"))


def normalised_offer(struct: str, merchant: Column, captured_at: Column) -> list[Column]:
    """The offer's fields under their common names, with the header's values for missing ones."""
    get = lambda *names: F.coalesce(*[tx.set_text(F.col(f"{struct}.{n}")) for n in names])
    same = ("name", "merchant_reference", "manufacturer_reference", "ean", "brand", "category", "variant", "packaging", "availability")
    price = F.replace(get("price_eur", "price"), F.lit(","), F.lit(".")).try_cast("double")
    return [
        F.coalesce(get("merchant"), merchant).alias("merchant"),
        get("source_url", "url").alias("source_url"),
        *[get(c).alias(c) for c in same],
        price.alias("price_eur"),
        get("image_url", "image").alias("image_url"),
        F.coalesce(get("captured_at"), captured_at).alias("captured_at"),
    ]


def json_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A checkpoint of one object per line: broken lines are skipped, the last line of a key wins."""
    from offerloom.operators.ranking import last_wins

    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    placed = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__line"))
    return last_wins(placed.filter(tx.is_set(key)), [key], ["__file", "__block", "__line"]).drop("__file", "__block", "__line")


def url_list(spark: SparkSession, path: str, host: str | None = None) -> DataFrame:
    """Distinct addresses of a text file, without comments and, with ``host``, of that host."""
    rows = spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> '' and not startswith(url, '#')")
    if host:
        rows = rows.filter(F.try_parse_url("url", F.lit("HOST")).isin(host, f"www.{host}"))
    return rows.distinct()


def sitemap(spark: SparkSession, path: str, host: str | None = None, least_priority: float = 0.0, pages_only: bool = False) -> DataFrame:
    """loc and priority of sitemap files; a missing priority is 0.5. ``pages_only`` keeps addresses that end in .html."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string, priority string, lastmod string").load(path)
    rows = rows.select(F.trim("loc").alias("loc"), F.coalesce(F.col("priority").try_cast("double"), F.lit(0.5)).alias("priority"), "lastmod")
    rows = rows.filter(F.col("loc").isNotNull() & (F.col("priority") >= least_priority) & (F.lower("loc").endswith(".html") | F.lit(not pages_only)))
    return rows.filter(F.try_parse_url("loc", F.lit("HOST")).isin(host, f"www.{host}")) if host else rows


def sitemap_tree(files: DataFrame, root: str, most_depth: int | None = None) -> DataFrame:
    """Distinct page addresses of a sitemap index and of all sitemaps below it; ``files`` has url and body of the captured files."""
    locs = lambda kind: F.regexp_extract_all("body", F.lit(rf"(?s)<{kind}>.*?<loc>\s*([^<]*?)\s*</loc>.*?</{kind}>"), F.lit(1))
    links = files.select(F.col("url").alias("source"), F.explode(locs("sitemap")).alias("target"))
    reached = frontier.reach(files.filter(F.col("url") == root).select("url"), links, most_depth)
    return files.join(reached.select("url"), "url", "left_semi").select(F.explode(locs("url")).alias("url")).select(F.replace("url", F.lit("&amp;"), F.lit("&")).alias("url")).distinct()


def html_pages(spark: SparkSession, path: str) -> DataFrame:
    """file and html of saved pages."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.html").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("html"))


def block_index(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a block index: key, timestamp, file, offset, length, block; incomplete lines are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    get = lambda i: F.try_element_at(parts, F.lit(i))
    rows = spark.read.text(path).select(get(1).alias("surt"), get(2).alias("timestamp"), get(3).alias("cdx_file"), get(4).try_cast("long").alias("offset"), get(5).try_cast("long").alias("length"), get(6).try_cast("long").alias("block_id"))
    return rows.filter("length is not null and block_id is not null")


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a capture index: key, timestamp and a JSON object."""
    return index_lines(spark.read.text(path), "value")


@F.pandas_udf(T.StringType())
def record_page(records: pd.Series) -> pd.Series:
    """The pages in compressed archive records."""
    return records.map(page_of_record, na_action="ignore")


def page_of_record(record: bytes) -> str | None:
    """The page in a compressed record: behind its own head and that of the answer, decoded as the answer or the page says."""
    _, _, answer = gzip.decompress(record).partition(b"\r\n\r\n")
    head, _, body = answer.partition(b"\r\n\r\n")
    if b"content-encoding: gzip" in head.lower():
        body = gzip.decompress(body)
    told = re.search(rb"charset=[\"']?([\w-]+)", head, re.I) or re.search(rb"charset=[\"']?([\w-]+)", body[:4096], re.I)
    try:
        return body.decode(told.group(1).decode() if told else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def index_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines of a capture index as rows: key, timestamp, url, status, filename, offset, length; others are skipped."""
    parts = F.split(line, " ", 3)
    schema = "url string, status string, filename string, offset string, length string, mime string"
    rows = lines.filter(F.size(parts) == 3).select(parts[0].alias("urlkey"), parts[1].alias("timestamp"), F.from_json(parts[2], schema).alias("j"))
    return rows.select("urlkey", "timestamp", "j.url", "j.status", "j.filename", F.col("j.offset").try_cast("long").alias("offset"), F.col("j.length").try_cast("long").alias("length")).filter("url is not null")


def newest_file(spark: SparkSession, path: str) -> DataFrame:
    """One row: the file changed last under a path or pattern, of equals the last by name."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"), F.max("modificationTime").alias("changed"))


def json_or_empty(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A JSON state, or no rows if the file is missing or broken."""
    try:
        rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
        rows.isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return rows
