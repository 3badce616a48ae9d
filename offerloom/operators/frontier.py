"""Reachability over a captured link table, as a crawl frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from offerloom.operators.ranking import numbered
from offerloom.plans.lineage import Growing, broadcast_if, cut


#: Bitmaps of seen pages (4 kB each, for 32,768 pages) up to which they are broadcast; beyond it the join is shuffled.
BITMAPS_BROADCAST = 2_000


def _marks(pages: DataFrame) -> DataFrame:
    """Bitmaps of page numbers, one per 32,768 numbers."""
    return pages.groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("seen"))


def _unseen(found: DataFrame, seen: DataFrame, n_bitmaps: int) -> DataFrame:
    rows = found.select("id", F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").alias("bit"))
    rows = rows.join(broadcast_if(seen, n_bitmaps, BITMAPS_BROADCAST), "bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(seen, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = F.expr("shiftright(byte, cast(bit % 8 as int)) & 1") == 1
    return rows.withColumn("byte", byte).filter(F.col("seen").isNull() | ~marked).select("id")


def reach(roots: DataFrame, links: DataFrame, most_depth: int | None = None) -> DataFrame:
    """url, depth: pages found from the roots over links (source, target), each at its least depth; without ``most_depth`` all that can be reached.

    Pages are numbered once and links become pairs of numbers. What was seen is a bit for each page, so a step reads its newest pages, their
    links and the bitmaps, however long the way was; placements grow by appending. Links without source or target lead nowhere.
    """
    spark, links = roots.sparkSession, cut(links.select("source", "target").dropna(), "links")  # read three times
    urls = roots.select("url").dropna().union(links.select("source")).union(links.select("target")).distinct()
    pages = numbered(urls, ["url"], "id")
    number = lambda name: pages.select(F.col("url").alias(f"__{name}"), F.col("id").alias(name))
    edges = links.join(number("s"), F.col("source") == F.col("__s")).join(number("t"), F.col("target") == F.col("__t")).select("s", "t")
    edges = cut(edges.distinct(), "edges")
    placed, depth = Growing(spark, "id long, depth int", "placed"), 0
    newest = cut(roots.select("url").distinct().join(pages, "url").select("id"), "newest")
    seen = cut(_marks(newest), "seen")
    while True:
        placed.add(newest.select("id", F.lit(depth).alias("depth")))
        if depth == most_depth:
            break
        found = newest.join(edges, F.col("id") == F.col("s")).select(F.col("t").alias("id")).distinct()
        newest = cut(_unseen(found, seen, seen.count()), "newest")
        if newest.isEmpty():
            break
        depth += 1
        seen = cut(seen.unionByName(_marks(newest)).groupBy("bucket").agg(F.bitmap_or_agg("seen").alias("seen")), "seen")
    return placed.read().join(pages, "id").select("url", "depth")


def next_pages(queue: DataFrame, batch: int) -> DataFrame:
    """The pending pages to fetch next: least depth first, then by address."""
    return queue.filter("status = 'pending'").orderBy("depth", "url").limit(batch)


def next_jobs(cursors: DataFrame, batch: int, most_page: int) -> DataFrame:
    """root, page: the next ``batch`` listing pages, taken from the roots in turn; ``cursors`` has root, place (the roots' order), next_page."""
    pages = cursors.select("root", "place", "next_page", F.explode(F.when(F.col("next_page") < most_page, F.sequence(F.col("next_page"), F.least(F.lit(most_page - 1), F.col("next_page") + batch - 1)))).alias("page"))
    return pages.orderBy(F.col("page") - F.col("next_page"), "place").limit(batch).select("root", "page")


def advance(cursors: DataFrame, jobs: DataFrame, done: DataFrame) -> DataFrame:
    """The cursors behind the jobs; a root goes back to its first page that was not done."""
    left = jobs.join(done.select("root", "page"), ["root", "page"], "left_anti").groupBy("root").agg(F.min("page").alias("__left"))
    taken = jobs.groupBy("root").agg((F.max("page") + 1).alias("__next"))
    out = cursors.join(taken, "root", "left").join(left, "root", "left")
    return out.withColumn("next_page", F.coalesce("__left", "__next", "next_page")).drop("__left", "__next")


def mark(queue: DataFrame, results: DataFrame) -> DataFrame:
    """The queue with the new states of (url, kind); one address may be of two kinds with a state each."""
    new = results.select("url", "kind", F.col("status").alias("__new"))
    return queue.join(new, ["url", "kind"], "left").withColumn("status", F.coalesce("__new", "status")).drop("__new")
