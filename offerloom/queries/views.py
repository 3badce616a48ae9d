"""The driver's tables as offers: suppliers are merchants, parts are products, line items are observations of an offer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from offerloom.functions import text as tx
from offerloom.operators.ranking import latest_per_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("merchant"), F.col("l_partkey").alias("product"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_returnflag").alias("availability"), F.col("l_shipdate").alias("scraped_at"), "l_orderkey", "l_linenumber",
    )


#: Observations are in this order; all of it together is unique.
TIE = ["l_orderkey", "l_linenumber"]


def latest_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_per_key(observations(spark, sf_dir), ["merchant", "product"], "scraped_at", TIE)


def basket_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dealt by basket, which also serves what counts a basket's items
    return table(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("product")).agg(F.sum("l_quantity").alias("qty"))


def cents(amount: Column | str) -> Column:
    """Two decimals; the small addend settles halves the same way whatever the order of a sum."""
    return F.floor(tx.col(amount) * 100 + 0.500001) / 100


CENTS = "floor({} * 100 + 0.500001) / 100"
OBSERVATIONS = "o AS (SELECT l_suppkey AS merchant, l_partkey AS product, l_extendedprice / l_quantity AS price, l_returnflag AS availability, l_shipdate AS scraped_at, l_orderkey, l_linenumber FROM lineitem)"
LATEST = OBSERVATIONS + ", l AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY merchant, product ORDER BY scraped_at DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM o) WHERE rn = 1)"
ITEMS = "i AS (SELECT l_orderkey AS basket, l_partkey AS product, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL)"
