"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from offerloom.llm.texts import crc32_of_id


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, text, label of at most ``rows`` labelled documents outside the held-out part, a row for each.

    The labels with the smallest hashes of their ids are taken, so the sample is the same on every run; it is broadcast to the
    documents. Of several labels of a document the largest counts, of rows repeated with its id the smallest text; labels
    without id or value are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    known = known.filter(crc32_of_id() % modulus != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
