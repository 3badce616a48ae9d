"""Shared column expressions and word helpers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Upper bound of a worker's word table; the table is emptied beyond it, which costs time and changes no result.
WORDS_KEPT = 100_000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` differs on ASCII results only for two letters that it maps into ASCII."""
    odd = text.contains("İ") | text.contains("K")
    return F.when(odd, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def crc32_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def as_bytes(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def table(spark, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give back the Arrow memory that a worker has kept; idle workers hold on to it otherwise."""
    pa.default_memory_pool().release_unused()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 8 << 20) -> Iterator[list[list]]:
    """The columns of ``batches`` as Python lists, some rows at a time: ``rows`` at most, fewer where rows are large."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield [column.slice(at, step).to_pylist() for column in batch.columns]


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_NON_SPACE = re.compile(r"[^\x20\x09-\x0D]")


def has_word(text: str) -> bool:
    return _NON_SPACE.search(text) is not None
