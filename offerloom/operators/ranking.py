"""Latest, richest and ranked rows; first and last wins. Every order is total: callers name enough columns to break ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from offerloom.functions.text import completeness
from offerloom.plans.lineage import cut


def turn(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> Column:
    return F.row_number().over(W.partitionBy(*keys).orderBy(*order))


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; a row number of 1 lets Spark keep one row per key and task before the shuffle."""
    return df.withColumn("__turn", turn(df, keys, order)).filter("__turn = 1").drop("__turn")


def latest_per_key(df: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str] = ()) -> DataFrame:
    """The newest row of each key; of equal times the largest ``tie`` columns."""
    return first_per_key(df, keys, [F.desc_nulls_last(time), *[F.desc_nulls_last(c) for c in tie]])


def first_wins(df: DataFrame, keys: Sequence[str | Column], seq: Sequence[str]) -> DataFrame:
    return first_per_key(df, keys, [F.asc(c) for c in seq])


def last_wins(df: DataFrame, keys: Sequence[str | Column], seq: Sequence[str], keep_position: bool = False) -> DataFrame:
    """The last row of each key; ``keep_position`` adds ``position``, the ``seq`` at which the key came first."""
    if not keep_position:
        return first_per_key(df, keys, [F.desc(c) for c in seq])
    first = F.first(F.struct(*seq)).over(W.partitionBy(*keys).orderBy(*seq).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return first_per_key(df.withColumn("position", first), keys, [F.desc(c) for c in seq])


def richest_per_key(df: DataFrame, keys: Sequence[str], columns: Sequence[str], seq: Sequence[str], last_on_tie: bool = True) -> DataFrame:
    """The row with most columns set; of equals the last, or the first."""
    direction = F.desc if last_on_tie else F.asc
    best = first_per_key(df.withColumn("richness", completeness(*columns)), keys, [F.desc("richness"), *[direction(c) for c in seq]])
    return best


def ranked(df: DataFrame, group: Sequence[str], price: str, seq: Sequence[str], most: int | None = None) -> DataFrame:
    """``price_rank`` 1..n inside a group; equal prices in the order of ``seq``. With ``most`` only the first ranks."""
    out = df.withColumn("price_rank", turn(df, group, [F.asc(price), *[F.asc(c) for c in seq]]))
    return out.filter(F.col("price_rank") <= most) if most else out


def page(df: DataFrame, order: Sequence[Column], size: int = 60, number: int = 0) -> DataFrame:
    """One page of the ordered rows."""
    return df.orderBy(*order).offset(size * number).limit(size)


def key_range(df: DataFrame, key: str, low: str, high: str, most: int | None = None) -> DataFrame:
    """Rows of [low, high) and the last one before it, as an index of sorted blocks needs: the block before may reach into the range.

    The predecessor is found by an aggregate, not by a window over the whole index.
    """
    inside = df.filter((F.col(key) >= low) & (F.col(key) < high))
    before = df.filter(F.col(key) < low).agg(F.max(key).alias("__last"))
    found = inside.unionByName(df.join(F.broadcast(before), F.col(key) == F.col("__last")).drop("__last"))
    return found.orderBy(key).limit(most) if most else found


def numbered(df: DataFrame, order: Sequence[str], column: str, parts: int = 64) -> DataFrame:
    """The rows with their numbers 1, 2, ... in the given order.

    Rows are numbered inside ranges of the order; the ranges' sizes, a row each, give what to add. No task sees all rows. The
    numbered rows are written once, as ranges are sampled anew each time they are made.
    """
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    inside = cut(ranged.withColumn("__at", F.row_number().over(W.partitionBy("__part").orderBy(*order))), "numbered")
    sizes = inside.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col("__part").alias("__p"), (F.sum("n").over(W.orderBy("__part")) - F.col("n")).alias("__before"))
    out = inside.join(F.broadcast(before), F.col("__part") == F.col("__p"))  # a row per range, ``parts`` at most
    return out.withColumn(column, F.col("__before") + F.col("__at")).drop("__part", "__at", "__p", "__before")


def running(df: DataFrame, order: Sequence[str], sums: dict[str, str], parts: int = 64, part: str | None = None) -> DataFrame:
    """The rows with, per new column, the sum of another column over all rows before them in the given order; 0 for the first.

    As ``numbered``: sums inside ranges of the order, and what the ranges before hold, a row each. ``part`` names a column for a row's range.
    """
    ranged = df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    before = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inside = cut(ranged.withColumns({new: F.coalesce(F.sum(c).over(before), F.lit(0)) for new, c in sums.items()}), "running")
    whole = inside.groupBy("__part").agg(*[F.sum(c).alias(f"__{new}") for new, c in sums.items()])
    up = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = whole.select(F.col("__part").alias("__p"), *[F.coalesce(F.sum(f"__{new}").over(up), F.lit(0)).alias(f"__{new}") for new in sums])
    out = inside.join(F.broadcast(offsets), F.col("__part") == F.col("__p"))  # a row per range, ``parts`` at most
    out = out.withColumns({new: F.col(new) + F.col(f"__{new}") for new in sums}).drop("__p", *[f"__{new}" for new in sums])
    return out.withColumnRenamed("__part", part) if part else out.drop("__part")
