"""Substring search by lists of three-letter grams.

An index is a folder: ``lists`` has for each gram and block of BLOCK ids the ids whose text holds it, in parts by ranges of grams; ``parts``
says which grams a part has, ``counts`` how many ids a gram has. A search reads the parts and lists of its rarest grams, intersects
them block by block, and looks the query up in the texts that are left. A frequent gram is many rows, none longer than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from offerloom.functions import text as tx

#: Bits of an id inside its block.
BLOCK_BITS = 16
#: Grams of a query that are intersected, the rarest; what is left is checked in the texts.
GRAMS = 4
#: Behind a text, so that its last letters begin grams as well.
_END = "\x00\x00"


def build(rows: DataFrame, key: str, text: Column | str, path: str, parts: int = 64) -> None:
    """Write the index of ``text`` by ``key`` (long) under a new folder. Texts are lower-cased; null ones have no grams."""
    grams = F.array_distinct(F.regexp_extract_all(F.concat(F.lower(tx.col(text)), F.lit(_END)), F.lit("(?s)(?=(...))"), F.lit(1)))
    held = rows.select(F.col(key).cast("long").alias("id"), F.explode(grams).alias("gram")).filter("id is not null")
    block, place = F.shiftright("id", BLOCK_BITS), F.col("id").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")
    lists = held.groupBy("gram", block.alias("block")).agg(F.sort_array(F.collect_set(place)).alias("places"))
    dealt = lists.repartitionByRange(parts, "gram", "block").withColumn("part", F.spark_partition_id()).sortWithinPartitions("gram", "block")
    dealt.write.partitionBy("part").parquet(f"{path}/lists")
    written = _lists(rows.sparkSession, path)
    written.groupBy("part").agg(F.min("gram").alias("low"), F.max("gram").alias("high")).coalesce(1).write.parquet(f"{path}/parts")
    written.groupBy("gram").agg(F.sum(F.size("places")).alias("n")).orderBy("gram").write.parquet(f"{path}/counts")


def _lists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("gram string, block long, places array<int>, part int").parquet(f"{path}/lists")


def lists_of(spark: SparkSession, path: str, low: str, high: str) -> DataFrame:
    """The lists of the parts that have grams from ``low`` to ``high``; the table of parts has a row for each."""
    known = spark.read.parquet(f"{path}/parts").filter((F.col("high") >= low) & (F.col("low") <= high)).select("part").collect()
    return _lists(spark, path).filter(F.col("part").isin([r["part"] for r in known]))


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame:
    """id: all whose text can hold the lower-cased ``query`` of one letter or more."""
    ids = (F.col("block") * (1 << BLOCK_BITS) + F.col("place")).alias("id")
    if len(query) < 3:
        found = lists_of(spark, path, query, query + "\U0010ffff").filter(F.startswith("gram", F.lit(query)))
        return found.select("block", F.explode("places").alias("place")).select(ids).distinct()
    grams = {query[i : i + 3] for i in range(len(query) - 2)}
    counts = spark.read.parquet(f"{path}/counts").filter(F.col("gram").isin(*grams)).collect()
    if len(counts) < len(grams):
        return spark.createDataFrame([], "id long")
    rarest = sorted(counts, key=lambda r: (r["n"], r["gram"]))[:GRAMS]
    lists = None
    for r in rarest:
        mine = lists_of(spark, path, r["gram"], r["gram"]).filter(F.col("gram") == r["gram"]).select("block", "places")
        lists = mine if lists is None else lists.unionByName(mine)
    blocks = lists.groupBy("block").agg(F.collect_list("places").alias("all")).filter(F.size("all") == len(rarest))
    common = F.aggregate(F.slice("all", 2, GRAMS), F.get("all", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return blocks.select("block", F.explode(common).alias("place")).select(ids)


def search(rows: DataFrame, key: str, text: Column | str, path: str, query: str) -> DataFrame:
    """The rows whose ``text`` holds ``query`` in any case, by the index that was built of them; an empty query finds all."""
    spark = rows.sparkSession
    low = spark.range(1).select(F.lower(F.lit(query)).alias("q")).first()["q"]  # as the texts are lower-cased
    if not low:
        return rows
    found = candidates(spark, path, low).withColumnRenamed("id", "__id")
    return rows.join(found, F.col(key) == F.col("__id"), "left_semi").filter(F.contains(F.lower(tx.col(text)), F.lit(low)))
