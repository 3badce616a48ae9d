"""Near-duplicate detection with SetSketch registers.

A document is the set of its 5-word shingles. Documents with equal sets form a class; all further work is on one row per
class. Each class gets a SetSketch (Ertl, 2021): register i holds K = floor(1 - log_B(min over the set of an exponentially
distributed hash)), truncated to a byte. Sketches merge by taking maxima, and equal registers are as likely as the sets are
similar. Bands of six registers propose candidates; the joint maximum-likelihood estimate from the numbers of larger,
smaller and equal registers discards hopeless ones; the rest are decided on the full sets.

Candidates never become all pairs of a bucket. First each class is compared with one leader of each of its buckets. Links
found so are joined into components. Buckets whose members are then in several components are compared in blocks inside
tasks, where a pair of one component is skipped, each pair is tested in the first band that it shares, and only links that
join two components leave the task. What is lost by this is nothing that could change a component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from offerloom.llm.components import components
from offerloom.llm.texts import WordHashes, as_bytes, release, table
from offerloom.plans.lineage import broadcast_if, cut

WORDS_IN_SHINGLE = 5
#: Links have THRESHOLD[1] * intersection >= THRESHOLD[0] * union.
THRESHOLD = (75, 100)
#: 42 whole bands. Unrelated sets of one size agree in a register with probability 0.024, so in some band with 8e-9; sets with
#: a similarity of 0.75 agree with 0.76 and miss all bands with 1.2e-4, with 0.8 with 1e-6.
REGISTERS, BAND = 256, 6
BASE, OFFSET = 1.1, 40
#: Pairs estimated below this are not verified: more than four standard errors of 256 registers under the threshold.
ESTIMATE = 0.63
#: Classes of a bucket that are compared with as many others at once, and shingles that these classes have on average at most.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
#: Pairs of classes that a task compares on average, and classes whose texts it compares.
PAIRS_IN_TASK, TEXTS_IN_TASK = 4_000_000, 2_000
#: Classes from which a bucket's rows are joined by a broadcast of such buckets, so that they stay spread over tasks.
LARGE_BUCKET = 100_000
#: Most ids broadcast to a reading of the texts; beyond it the join is shuffled.
IDS_BROADCAST = 500_000

_rng = np.random.default_rng(20210105)
_FACTORS = (_rng.integers(0, 1 << 31, REGISTERS, np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, REGISTERS, np.uint32)
_MIX = _rng.integers(0, 1 << 63, WORDS_IN_SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_words = WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes) -> np.ndarray:
    """The set of a text as sorted distinct 64-bit shingle hashes; with fewer words the whole sequence is one."""
    words = text.lower().split()  # on bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h, n = _words.of(words), max(1, len(words) - WORDS_IN_SHINGLE + 1)
    k = min(len(words), WORDS_IN_SHINGLE)
    total = np.full(n, (k * 0xD6E8FEB86659FD93) % (1 << 64), np.uint64)
    for i in range(k):
        total += _mixed(h[i : i + n] + _MIX[i]) * _MIX[i]
    return np.unique(_mixed(total))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set."""
    h, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 2048):
        np.minimum(least, (_FACTORS[:, None] * h[None, at : at + 2048] + _SHIFTS[:, None]).min(axis=1), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 + OFFSET - np.log(exponential) / np.log(BASE)), 0, 255).astype(np.uint8)


def likely(larger: np.ndarray, equal: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, least: float = ESTIMATE) -> np.ndarray:
    """Whether the likelihood estimate of the similarity is at least ``least``.

    With x = u - vJ and y = v - uJ for the shares u and v of the sizes, a register is larger with probability
    p(x) = -log_B(1 - x (B - 1) / B) and smaller with p(y). The log-likelihood is concave, so the estimate reaches ``least``
    exactly if its slope there is not negative.
    """
    u, c = n_u / (n_u + n_v), (BASE - 1) / BASE
    v = 1 - u
    smaller = REGISTERS - larger - equal
    x, y = np.maximum(u - v * least, 1e-9), np.maximum(v - u * least, 1e-9)
    p = lambda z: -np.log1p(-z * c) / np.log(BASE)
    slope = lambda z: c / ((1 - z * c) * np.log(BASE))
    down, up = larger * v * slope(x) / p(x) + smaller * u * slope(y) / p(y), equal * (v * slope(x) + u * slope(y)) / np.maximum(1 - p(x) - p(y), 1e-9)
    return up >= down


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two full sets reach the threshold."""
    part, whole = THRESHOLD
    if not len(a) or not len(b) or whole * min(len(a), len(b)) < part * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return whole * common >= part * (len(both) - common)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            sizes, digests, registers = [], [], []
            for text in batch.column(1).slice(at, 512).to_pylist():
                s = shingles(text)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                registers.append(sketch(s).tobytes() if len(s) else None)
            yield pa.record_batch([batch.column(0).slice(at, 512), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(registers, pa.binary())], ["doc_id", "n_shingles", "digest", "registers"])
    _words.clear()
    release()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set, registers; the last two null for an empty set."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text"))
    return rows.mapInArrow(_sketched, "doc_id long, n_shingles long, digest binary, registers binary")


def _sets(docs: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """rep, words (the text's bytes) of the classes in ``ids``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), as_bytes().alias("body"))
    return texts.join(broadcast_if(ids, count, IDS_BROADCAST), "rep", "left_semi").dropDuplicates(["rep"])


@F.pandas_udf(T.BooleanType())
def _linked_texts(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([linked(shingles(x), shingles(y)) for x, y in zip(a, b)], dtype=bool)
    _words.clear()
    release()


@F.pandas_udf(T.BooleanType())
def _likely_registers(ra: pd.Series, rb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
    if not len(ra):
        return pd.Series([], dtype=bool)
    a, b = (np.frombuffer(b"".join(x), np.uint8).reshape(-1, REGISTERS) for x in (ra, rb))
    sizes = np.minimum(na, nb) * THRESHOLD[1] >= np.maximum(na, nb) * THRESHOLD[0]
    return pd.Series(likely((a > b).sum(1), (a == b).sum(1), na.to_numpy(float), nb.to_numpy(float)) & sizes.to_numpy())


class _Forest:
    """Which labels of a block have been joined so far."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.above.get(x, x)) != x:
            self.above[x] = x = self.above.get(y, y)
        return x

    def join(self, a: int, b: int) -> None:
        self.above[self.top(a)] = self.top(b)


def _block_pairs(group: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a task's block that may be linked: of two components, sharing this band first, likely, alike in size."""
    band, first, second = int(group.band.iloc[0]), int(group.i.iloc[0]), int(group.j.iloc[0])
    k = np.frombuffer(b"".join(group.registers), np.uint8).reshape(-1, REGISTERS)
    n, comp, block = group.n_shingles.to_numpy(float), group.component.to_numpy(), group.block.to_numpy()
    a, b = np.flatnonzero(block == first), np.flatnonzero(block == second)
    for at in range(0, len(a), 64):
        x = a[at : at + 64]
        open_ = comp[x][:, None] != comp[b][None, :]
        if first == second:
            open_ &= x[:, None] < b[None, :]
        open_ &= np.minimum(n[x][:, None], n[b][None, :]) * THRESHOLD[1] >= np.maximum(n[x][:, None], n[b][None, :]) * THRESHOLD[0]
        xi, bi = np.nonzero(open_)
        for part in range(0, len(xi), 8192):
            left, right = x[xi[part : part + 8192]], b[bi[part : part + 8192]]
            same = k[left] == k[right]
            earlier = same[:, : band * BAND].reshape(len(left), band, BAND).all(2).any(1)
            ok = ~earlier & likely((k[left] > k[right]).sum(1), same.sum(1), n[left], n[right])
            yield left[ok], right[ok]


def _survivors(group: pd.DataFrame) -> pd.DataFrame:
    """The classes of a block that are in at least one pair to verify."""
    keep = np.zeros(len(group), bool)
    for left, right in _block_pairs(group):
        keep[left] = keep[right] = True
    return group.loc[keep]


def _verified(group: pd.DataFrame) -> pd.DataFrame:
    """Links of a block, enough to join what the block joins."""
    rep, comp, forest, links = group.rep.to_numpy(), group.component.to_numpy(), _Forest(), []
    sets = [shingles(x) for x in group.body]
    for left, right in _block_pairs(group):
        for a, b in zip(left, right):
            if forest.top(comp[a]) != forest.top(comp[b]) and linked(sets[a], sets[b]):
                forest.join(comp[a], comp[b])
                links.append((int(rep[a]), int(rep[b])))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


_IN_BLOCK = "bucket long, band int, i int, j int, block int, rep long, component long, n_shingles long, registers binary"


def _bands(classes: DataFrame) -> DataFrame:
    """A row per class and band: rep, bucket (a hash of the band's registers, with the band's number in the low bits)."""
    starts = [F.xxhash64(F.lit(i), F.substring("registers", 1 + i * BAND, BAND)).bitwiseAND(F.lit(-64)).bitwiseOR(F.lit(i)) for i in range(REGISTERS // BAND)]
    return classes.select("rep", F.explode(F.array(*starts)).alias("bucket"))


def _of_bucket(bands: DataFrame, buckets: DataFrame) -> DataFrame:
    """``bands`` joined with ``buckets`` (bucket, n, ...); rows of very large buckets are not gathered by their bucket."""
    large = buckets.filter(F.col("n") > LARGE_BUCKET)
    n_large = large.count()
    if not n_large:
        return bands.join(buckets, "bucket")
    # a bucket in LARGE_BUCKET rows at most
    return bands.join(buckets.filter(F.col("n") <= LARGE_BUCKET), "bucket").unionByName(bands.join(broadcast_if(large, n_large, IDS_BROADCAST), "bucket"))


def _first_links(docs: DataFrame, classes: DataFrame, bands: DataFrame, leaders: DataFrame) -> DataFrame:
    """Links between classes and the leaders of their buckets."""
    pairs = _of_bucket(bands.select("rep", "bucket"), leaders).filter("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    slim = classes.select("rep", "n_shingles", "registers")
    pairs = pairs.join(slim.toDF("a", "na", "ra"), "a").join(slim.toDF("b", "nb", "rb"), "b")
    pairs = cut(pairs.filter(_likely_registers("ra", "rb", "na", "nb")).select("a", "b"), "pairs")
    ids = cut(pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct(), "ids")
    sets = cut(_sets(docs, ids, ids.count()), "sets")
    texts = pairs.join(sets.toDF("a", "ba"), "a").join(sets.toDF("b", "bb"), "b")
    return cut(texts.filter(_linked_texts("ba", "bb")).select("a", "b"), "links")


def _rest_links(docs: DataFrame, classes: DataFrame, bands: DataFrame, found: DataFrame, block: int) -> DataFrame | None:
    """Links inside buckets whose members are in several components after the first links; None without such buckets.

    Both blocks of every pair of blocks of a bucket meet in one group; the number of tasks follows from the number of pairs.
    """
    label = found.withColumnRenamed("node", "rep")
    members = bands.join(label, "rep", "left").join(classes.select("rep", "n_shingles"), "rep")
    members = members.select("rep", "bucket", "n_shingles", F.coalesce("component", "rep").alias("component"), F.col("bucket").bitwiseAND(F.lit(63)).cast("int").alias("band"))
    mixed = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"), F.min("component").alias("least"), F.max("component").alias("most")).filter("n > 2 and least <> most")
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("size") / BLOCK_SHINGLES)).cast("int")
    mixed = cut(mixed.select("bucket", "n", blocks.alias("blocks")), "mixed")
    pairs = mixed.agg(F.sum(F.col("n") * F.col("n") / 2)).first()[0]
    if not pairs:
        return None
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / PAIRS_IN_TASK))
    members = _of_bucket(members, mixed).withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).join(classes.select("rep", "registers"), "rep")
    columns, group = [x.split()[0] for x in _IN_BLOCK.split(", ")], ["bucket", "i", "j"]
    kept = cut(members.select(*columns).repartition(tasks, *group).groupBy(*group).applyInPandas(lambda g: _survivors(g)[columns], _IN_BLOCK), "survivors")
    n_kept = kept.count()
    if not n_kept:
        return None
    ids = cut(kept.select("rep").distinct(), "ids")
    sets = _sets(docs, ids, ids.count())
    return cut(kept.join(sets, "rep").repartition(max(8, math.ceil(n_kept / TEXTS_IN_TASK)), *group).groupBy(*group).applyInPandas(_verified, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Null and empty texts and texts without words have an empty set, link with nothing and are kept. Rows repeated with one id
    are each returned; their texts should be equal, else the id stands for all of them. Rows without an id link with nothing.
    An empty table gives no rows. Other columns are not read.
    """
    rows = cut(sketches(docs), "sketches")
    classes = rows.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.max("registers").alias("registers"))
    classes = cut(classes, "classes")
    buckets = _bands(classes)
    shared = buckets.groupBy("bucket").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = cut(shared, "buckets")
    bands = cut(buckets.join(shared, "bucket", "left_semi"), "bands")
    # most classes share no bucket; their registers are not moved again
    active = cut(classes.select("rep", "n_shingles", "registers").join(bands.select("rep").distinct(), "rep", "left_semi"), "active")
    first = _first_links(docs, active, bands, shared)
    found = cut(components(first), "found")
    rest = _rest_links(docs, active, bands, found, block)
    if rest is not None and rest.limit(1).count():
        found = cut(components(first.unionByName(rest)), "found")
    of_class = classes.select("digest", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("digest").alias("d"), F.coalesce("component", "rep").alias("component"))
    # classes of one row need no join; the join of the others may be split at a large class
    joined = rows.select("doc_id", "n_shingles", "digest").join(of_class, F.col("digest") == F.col("d"), "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``; of rows repeated with one id all that are kept."""
    own = "_" * (1 + max(map(len, docs.columns)))  # a name that docs doesn't have
    gone = cut(near_duplicates(docs).filter("not kept and doc_id is not null").select("doc_id").distinct(), "gone").withColumnRenamed("doc_id", own)
    return docs.join(broadcast_if(gone, gone.count(), IDS_BROADCAST), docs["doc_id"].cast("long") == F.col(own), "left_anti")


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir))


#: Plain sets and all pairs with a shared shingle.
ORACLES = {
    "op2_minhash_near_dedup": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
x AS (SELECT doc_id, len(words) AS k, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM w),
g AS (
  SELECT doc_id, k, place, concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS shingle
  FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY place)),
s AS (SELECT DISTINCT doc_id, shingle FROM g WHERE place <= greatest(1, k - 4)),
e AS (SELECT doc_id, count(*) OVER (PARTITION BY doc_id) AS n, shingle FROM s),
l AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
n AS (SELECT doc_id, count(shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
c(node, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT c.node, l.b FROM c JOIN l ON c.reached = l.a)
SELECT doc_id, any_value(n) AS n_shingles, min(reached) AS component_id, doc_id = min(reached) AS kept FROM n JOIN c ON c.node = n.doc_id GROUP BY doc_id"""
}
