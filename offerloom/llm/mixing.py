"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed hash. The sizes are summed by source and by the leading bits of the hash; the running sum
shows in which bucket a source's budget ends, and only the documents of that bucket are summed again by the next bits,
until the bits are used up. What remains is one threshold per source, so that the mix is a filter without a sort; a
larger budget keeps what a smaller one took.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from offerloom.llm.texts import WORD, table
from offerloom.operators.ranking import numbered, running
from offerloom.plans.lineage import broadcast_if, cut

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2.0
#: Bits of the hash in a histogram, and the number of histograms.
BITS, LEVELS = 12, 5
#: Most sources for which a table with a row per source is broadcast; beyond it the join is shuffled.
SOURCES_BROADCAST = 50_000
#: Sources in a range when they are ordered.
SOURCES_PER_RANGE = 10_000


def hash60(doc_id: Column) -> Column:
    """The first 60 bits of the id's md5 as a long; a null id counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, n_sources: int, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """A row per source of ``sizes`` (source, source_size): target.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``total`` times all sizes; a target stops at
    ``most`` times the source's size and the excess is shared by weight again until none is above. This is the level at
    which min(most * size, level * weight) adds up to the total: sources in the order of most * size / weight are capped as
    long as the level that the rest would get is not below.
    """
    parts = max(1, min(64, n_sources // SOURCES_PER_RANGE))
    named = sizes.select("source", F.col("source_size").cast("long").alias("source_size"), F.col("source").isNull().alias("none"), F.col("source").cast("binary").alias("name"))
    turns = numbered(named, ["none", "name"], "turn", parts)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("turn") - 1) % len(weights) + 1).cast("int")).cast("double")
    w = turns.withColumns({"weight": weight, "cap": F.lit(most) * F.col("source_size")}).withColumn("ratio", F.col("cap") / F.col("weight"))
    w = running(w, ["ratio", "none", "name"], {"capped": "cap", "gone": "weight"}, parts)
    sums = w.agg(F.sum("weight").alias("weight"), F.sum("source_size").alias("size")).first()
    level = (F.lit(total * float(sums["size"] or 0)) - F.col("capped")) / (F.lit(float(sums["weight"] or 1)) - F.col("gone"))
    fits = F.col("cap") > level * F.col("weight")
    level = w.agg(F.max(F.when(fits, level)).alias("level")).first()["level"]  # the first that fits has the highest level
    target = F.col("cap") if level is None else F.least("cap", F.lit(level) * F.col("weight"))
    return w.select("source", "source_size", target.alias("target"))


def _threshold(rows: DataFrame, aims: DataFrame, n_sources: int, name: str) -> DataFrame:
    """``aims`` (source, target, source_size, rounds, budget) with ``upto``: documents with a hash below it are taken once more.

    Each level looks only at the bucket in which the budget ends.
    """
    small = lambda df: broadcast_if(df, n_sources, SOURCES_BROADCAST)
    at = aims.withColumns({"prefix": F.lit(0).cast("long"), "left": F.col("budget").cast("double")})
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = rows.join(small(at.select(F.col("source").alias("s"), F.col("prefix").alias("p"))), F.col("source").eqNullSafe(F.col("s")))
        inside = inside.filter(F.shiftright("hash", shift + BITS) == F.col("p"))
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        upto = W.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("size").over(upto))
        sums = sums.join(small(at.select(F.col("source").alias("s"), F.col("left").alias("l"))), F.col("source").eqNullSafe(F.col("s")))
        # the bucket in which the budget ends, and what lies before it
        ends = sums.filter((F.col("upto") > F.col("l"))).groupBy("source").agg(F.min(F.struct("bucket", "upto", "size")).alias("end"))
        ends = ends.select(F.col("source").alias("s"), F.col("end.bucket").alias("end"), (F.col("end.upto") - F.col("end.size")).alias("before"), F.col("end.size").alias("last"))
        at = at.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        if level == LEVELS:
            # the last bucket is taken if that brings the sum nearer to the budget
            near = F.col("before") + F.col("last") - F.col("left") < F.col("left") - F.col("before")
            return at.withColumn("upto", F.when(F.col("end").isNull(), F.lit(1 << BITS * LEVELS)).otherwise(F.col("end") + near.cast("long"))).drop("prefix", "left", "end", "before", "last")
        # without such a bucket all are taken: the prefix then lies beyond all hashes
        at = cut(at.select(*aims.columns, F.coalesce("end", F.lit(1 << BITS * level)).alias("prefix"), F.when(F.col("end").isNull(), 0.0).otherwise(F.col("left") - F.col("before")).alias("left")), f"{name}{level}")
    raise ValueError("LEVELS must be at least 1")


def measured(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).alias("n")).select("doc_id", "source", F.coalesce("n", F.lit(0)).cast("long").alias("size"), hash60(F.col("doc_id")).alias("hash"))


def thresholds(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> tuple[DataFrame, int]:
    """From rows (source, size, hash) a row per source: source_size, target, rounds (whole passes), upto; and their count."""
    sizes = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    n_sources = sizes.count()
    aims = targets(sizes, n_sources, weights, total, most)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aims = aims.withColumn("rounds", rounds).withColumn("budget", F.col("target") - F.col("rounds") * F.col("source_size"))
    return cut(_threshold(rows, cut(aims, "aims"), n_sources, "level"), "thresholds"), n_sources


def taken_times(most: float = MOST) -> Column:
    return F.least(F.col("rounds") + (F.col("hash") < F.col("upto")).cast("long"), F.lit(int(most)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, times, taken (= times * size).

    Size is the number of words, 0 for a null text. A null source is a source. Documents with the same id share a hash and are
    taken or left together; a source's taken words differ from its target by no more than half the size of the documents at
    its threshold. Equal inputs give equal results. An empty table gives no rows. Other columns are not read.
    """
    rows = cut(measured(docs), "measured")
    per_source, n_sources = thresholds(rows, weights, total, most)
    right = broadcast_if(per_source.withColumnRenamed("source", "s"), n_sources, SOURCES_BROADCAST)
    joined = rows.join(right, F.col("source").eqNullSafe(F.col("s"))).withColumn("times", taken_times(most))
    return joined.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``."""
    rows = cut(measured(docs), "measured")
    per_source, n_sources = thresholds(rows)
    right = broadcast_if(per_source.select(F.struct(F.col("source").alias("s"), "rounds", "upto").alias("_mix")), n_sources, SOURCES_BROADCAST)
    docs, own = docs.alias("d"), "_" * (1 + max(map(len, docs.columns)))
    joined = docs.join(right.withColumnRenamed("_mix", own), F.col("d.source").eqNullSafe(F.col(f"{own}.s")))
    times = F.least(F.col(f"{own}.rounds") + (hash60(F.col("d.doc_id")) < F.col(f"{own}.upto")).cast("long"), F.lit(int(MOST)))
    again = joined.filter(times > 0).select("d.*", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias(own))
    return again.drop(own)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLES = {
    "op10_mixing": """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM s),
r AS (
  SELECT *, cap / weight AS ratio,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM w),
lv AS (
  SELECT max((total - capped) / rest) AS level FROM r WHERE cap > (total - capped) / rest * weight),
t AS (
  SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM r, lv),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS rounds FROM t),
c AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.rounds, b.target - b.rounds * b.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(size * least(2, rounds + CASE WHEN upto <= budget OR (before <= budget AND upto - budget < budget - before) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c"""
}
