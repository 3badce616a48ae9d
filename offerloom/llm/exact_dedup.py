"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Every row gets the SHA-256 of its text without white space and a 60-bit fingerprint from its head. The rows' slim
   columns are written once; the task that wrote a row is its sender. Where tasks are so many that messages would hold few
   fingerprints, tasks in a row are one sender, and its fingerprints (16 bytes each) are brought together before they are coded.
2. Each sender sends, to the owner of each fingerprint range, its distinct fingerprints sorted and Golomb-Rice coded, with
   a bit for those that it holds several times. However large a group of copies is, an owner hears of it once per sender.
3. The owner merges the lists and answers every sender with a bitmap of the fingerprints that occur twice or more.
4. The senders' rows under set bits are suspects. Only their texts are shuffled; grouping by the whole text compares bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from offerloom.llm.texts import table
from offerloom.plans.lineage import broadcast_if, cut

#: Rows whose fingerprints one owner merges, on average, and fingerprints that a sender's message to an owner holds at least, on average.
OWNED, MESSAGE = 4_000_000, 500
#: Most suspects whose ids are broadcast to the second reading of the texts; beyond it the join is shuffled.
SUSPECTS_BROADCAST = 500_000
#: Bits of a fingerprint that are kept, and that are sent: 14 more than number the rows, so one row in 16,000 is suspected by chance.
FINGERPRINT_BITS, SENT_BITS = 60, 14


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def rice_parameter(count: int, span: int) -> int:
    """Low bits kept as they are: log2 of the mean gap."""
    return max(0, (span // max(count, 1)).bit_length() - 1)


def golomb_encode(values: np.ndarray, span: int) -> bytes:
    """Ascending distinct values below ``span``: gaps as unary quotient and ``rice_parameter`` low bits."""
    k = rice_parameter(len(values), span)
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(-1)) - 1
    quotients = gaps >> k
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(values) else 0, np.uint8)
    unary[ends] = 1
    low = ((gaps[:, None] >> np.arange(k)) & 1).astype(np.uint8).ravel()
    return np.packbits(np.concatenate((unary, low))).tobytes()


def golomb_decode(blob: bytes, count: int, span: int) -> np.ndarray:
    if not count:
        return np.zeros(0, np.int64)
    k = rice_parameter(count, span)
    bits = np.unpackbits(np.frombuffer(blob, np.uint8))
    ends = np.flatnonzero(bits)[:count]
    quotients = np.diff(ends, prepend=-1) - 1
    low = bits[ends[-1] + 1 : ends[-1] + 1 + count * k].reshape(count, k).astype(np.int64) @ (1 << np.arange(k, dtype=np.int64))
    return np.cumsum((quotients.astype(np.int64) << k) + low + 1) - 1


def sent_bits(rows: int) -> int:
    return min(FINGERPRINT_BITS, max(24, rows.bit_length() + SENT_BITS))


def exchange_of(count: int, tasks: int) -> tuple[int, int]:
    """Owners, and tasks that are one sender, for ``count`` rows written by ``tasks`` tasks: a message then holds MESSAGE fingerprints or more.

    At any size there are at most OWNED / MESSAGE senders, unless rows are so few that all fit few owners.
    """
    owners = max(8, -(-count // OWNED))
    senders = max(1, min(tasks, count // (owners * MESSAGE)))
    return owners, -(-tasks // senders)


def _span(owners: int, bits: int) -> int:
    """Fingerprints of an owner's range."""
    return -(-(1 << bits) // owners)


_SENT = "sender long, owner long, n long, blob binary, several binary"


def _send(owners: int, bits: int):
    """Per sender and owner the coded fingerprints; the rows of a sender arrive in one task, a few bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            sender, value = (batch.column(i).to_numpy() for i in range(2))
            for s in np.unique(sender):
                held.setdefault(int(s), []).append(value[sender == s])
        for s, parts in held.items():
            values, counts = np.unique(np.concatenate(parts), return_counts=True)
            span = _span(owners, bits)
            owner = values // span
            rows = [(s, int(o), int((m := owner == o).sum()), golomb_encode(values[m] - o * span, span), np.packbits(counts[m] > 1).tobytes()) for o in np.unique(owner)]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["sender", "owner", "n", "blob", "several"]), preserve_index=False)

    return run


def _answer(owners: int, bits: int):
    """The owner's bitmaps: which of each sender's fingerprints occur twice or more anywhere."""

    def run(sent: pd.DataFrame) -> pd.DataFrame:
        span = _span(owners, bits)
        lists = [golomb_decode(b, n, span) for b, n in zip(sent.blob, sent.n)]
        several = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(sent.several, sent.n)]
        everything = np.concatenate(lists)
        values, counts = np.unique(everything, return_counts=True)
        twice = np.union1d(values[counts > 1], everything[np.concatenate(several)])
        maps = [np.packbits(np.isin(x, twice)).tobytes() for x in lists]
        return pd.DataFrame({"sender": sent.sender, "owner": sent.owner, "n": sent.n, "blob": sent.blob, "bitmap": maps})

    return run


_ANSWERED = "sender long, owner long, n long, blob binary, bitmap binary"


def _suspected(owners: int, bits: int):
    """The fingerprints under a sender's set bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = _span(owners, bits)
        for batch in batches:
            senders, values = [], []
            for sender, owner, n, blob, bitmap in zip(*(batch.column(i).to_pylist() for i in range(5))):
                marked = golomb_decode(blob, n, span)[np.unpackbits(np.frombuffer(bitmap, np.uint8), count=n).astype(bool)]
                senders.append(np.full(len(marked), sender))
                values.append(marked + owner * span)
            if senders:
                yield pa.record_batch([pa.array(np.concatenate(senders).astype(np.int64)), pa.array(np.concatenate(values).astype(np.int64))], ["sender", "fingerprint"])

    return run


def fingerprints(docs: DataFrame) -> DataFrame:
    """The slim rows: doc_id, n_chars, sha (binary), fingerprint, sender."""
    sha = F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), sha.alias("sha"))
    head = F.conv(F.substring(F.hex("sha"), 1, FINGERPRINT_BITS // 4), 16, 10).cast("long")
    return cut(rows.select("*", head.alias("fingerprint"), F.spark_partition_id().cast("long").alias("sender")), "fingerprints")


def suspects(rows: DataFrame, count: int) -> DataFrame:
    """The rows of ``fingerprints`` whose fingerprint occurs twice or more, found by the coded exchange."""
    tasks, bits = 1 + (rows.agg(F.max("sender").alias("s")).first()["s"] or 0), sent_bits(count)
    owners, together = exchange_of(count, tasks)
    rows = rows.withColumns({"fingerprint": F.shiftright("fingerprint", FINGERPRINT_BITS - bits), "sender": F.floor(F.col("sender") / together)})
    told = rows.select("sender", "fingerprint")
    if together > 1:
        told = told.repartition(-(-tasks // together), "sender")
    sent = told.mapInArrow(_send(owners, bits), _SENT)
    answers = sent.groupBy("owner").applyInPandas(_answer(owners, bits), _ANSWERED)
    marked = answers.select(*(x.split()[0] for x in _ANSWERED.split(", "))).mapInArrow(_suspected(owners, bits), "sender long, fingerprint long")
    # a fingerprint is marked once per sender, and both key the join: a hot fingerprint's rows stay spread over its senders
    marked = cut(marked.distinct(), "marked")
    return rows.join(broadcast_if(marked, marked.count(), SUSPECTS_BROADCAST), ["sender", "fingerprint"])


def _plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The slim rows, and per SHA of a group of at least two rows: keep_id, group_size, n_keep (rows with that id and text)."""
    rows = fingerprints(docs)
    count = rows.count()
    suspect = cut(suspects(rows, count).select("doc_id", "sha", "n_chars"), "suspects")
    n_suspects = suspect.count()
    ids = broadcast_if(suspect.select(F.col("doc_id").alias("id")).distinct(), n_suspects, SUSPECTS_BROADCAST)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    texts = texts.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), normalised(F.col("text")).alias("body"))
    # bytes are compared here: rows of a group share the whole body. Copies collapse in each task before the shuffle.
    by_length = texts.groupBy("body", "n_chars").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    by_length = by_length.select(F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("sha"), F.xxhash64("body").alias("body"), "n_chars", "doc_id", "n")
    groups = by_length.groupBy("sha").agg(
        F.max(F.struct(F.col("n_chars"), F.coalesce(-F.col("doc_id"), F.lit(-(1 << 63))).alias("less"), F.col("doc_id").alias("id"))).alias("keep"),
        F.sum("n").alias("group_size"),
        F.count_distinct("body").alias("bodies"),
    )
    checked = F.when(F.col("bodies") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("different texts share a SHA-256")).cast("long"))
    groups = groups.select(F.col("sha").alias("group_sha"), F.col("keep.id").alias("keep_id"), F.col("keep.n_chars").alias("keep_chars"), checked.alias("group_size"))
    return rows, cut(groups.filter("group_size > 1"), "groups")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most characters stays, then the smallest id (null last). Rows repeated with the same id and
    text each count in ``group_size``; one of them is kept. Null and empty texts are equal. An empty table gives no rows.
    Other columns are not read.
    """
    rows, groups = _plan(docs)
    n_groups = groups.count()
    joined = rows.join(broadcast_if(groups, n_groups, SUSPECTS_BROADCAST // 4), F.col("sha") == F.col("group_sha"), "left")
    single = F.col("group_sha").isNull()
    joined = joined.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "n_chars",
    )
    # rows repeated with the id that stays are alike in all columns: they are counted, and one of them is kept
    columns = ["doc_id", "keep_id", "group_size", "text_sha256"]
    firsts = joined.filter("kept and group_size > 1").groupBy(*columns).agg(F.count(F.lit(1)).cast("int").alias("n"))
    firsts = firsts.select(*columns, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("turn")).select(*columns, (F.col("turn") == 1).alias("kept"))
    return joined.filter("not (kept and group_size > 1)").drop("n_chars").unionByName(firsts).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    rows = deduplicate(docs).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    verdict = cut(rows.filter("not kept or n > 1"), "verdict")
    own = "_" * (1 + max(map(len, docs.columns)))  # a name that docs doesn't have
    row = F.struct(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).alias(own)
    gone, repeated = verdict.filter("not kept").select(row), verdict.filter("kept and n > 1").select(row)
    sha = F.sha2(normalised(docs["text"]).cast("binary"), 256)
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(f"{own}.id")) & (sha == F.col(f"{own}.sha"))
    small = lambda df: broadcast_if(df, df.count(), SUSPECTS_BROADCAST // 4)
    kept = docs.join(small(gone), same, "left_anti")
    if not (n := repeated.count()):
        return kept
    again = broadcast_if(repeated, n, SUSPECTS_BROADCAST // 4)
    once = kept.join(again, same, "left_anti")
    # rows repeated with one id and text collapse in each task before the shuffle
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    twice = kept.join(again, same, "left_semi").groupBy(docs["doc_id"].alias(f"{own}i"), sha.alias(f"{own}s")).agg(F.max_by(row, F.char_length(docs["text"])).alias(own))
    return once.unionByName(twice.select(*[F.col(own)[c].alias(c) for c in docs.columns]))


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir))


ORACLES = {
    "op7_exact_dedup": """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id,
       CAST(count(*) OVER (PARTITION BY body) AS BIGINT) AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY n DESC, doc_id) = 1 AS kept,
       sha256(body) AS text_sha256
FROM d"""
}
