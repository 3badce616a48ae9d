"""Packing by power-of-two decomposition.

Every document is encoded, closed with id 0 and cut into pieces whose lengths are powers of two: as many pieces of the
context length as fit, then the binary digits of the rest, largest first. A piece is a sequence of its own in the bucket
of its length, so no sequence crosses documents and none needs padding.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from offerloom.llm.texts import release, table

CONTEXT = 1024
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: Splits texts as the vocabulary's own pattern does, with less backtracking.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Characters outside these blocks may be classed differently by the two libraries' Unicode tables.
_OTHER_SCRIPT = re.compile("[^\x00-\u05ff\u2000-\u206f\u20a0-\u20bf]")
_loaded: dict[tuple[str, str], "Encoder"] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts by the tokenizer in ``path``; ``ranks`` holds the same vocabulary.

    Texts in common scripts are encoded with the ranks, which is several times faster and gives the same ids; all others,
    and those that hold the string of an added token, by the tokenizer itself at its defaults.
    """

    def __init__(self, path: str, ranks: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as lines:
            vocabulary = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=vocabulary, special_tokens={})
        self.tokenizer = Tokenizer.from_file(path)
        added = {rank: token.content for rank, token in self.tokenizer.get_added_tokens_decoder().items()}
        self.slow = re.compile("|".join([_OTHER_SCRIPT.pattern, *map(re.escape, added.values())]))
        self.widths = np.zeros(max(*vocabulary.values(), *added) + 2, np.int64)
        for token, rank in [*vocabulary.items(), *((content.encode(), rank) for rank, content in added.items())]:
            self.widths[rank] = len(token)

    def ids(self, text: str) -> np.ndarray:
        if self.slow.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text).astype("<u4", copy=False)

    def first_chars(self, text: str, ids: np.ndarray) -> np.ndarray:
        """For each token the place, in characters of the text, of the character that holds its first byte."""
        first = np.cumsum(self.widths[ids]) - self.widths[ids]
        if text.isascii():
            return first
        starts = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        return (np.cumsum(starts) - 1)[first]


def encoder(path: str | None = None, ranks: str | None = None) -> Encoder:
    key = (path or tokenizer_path(), ranks or tokenizer_path(RANKS))
    if key not in _loaded:
        _loaded[key] = Encoder(*key)
    return _loaded[key]


def lengths(tokens: int, context: int) -> list[int]:
    """The lengths of a document's pieces, in order."""
    rest = tokens % context
    return [context] * (tokens // context) + [1 << k for k in range(context.bit_length() - 1, -1, -1) if rest >> k & 1]


_SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary"


def _cut(path: str | None, ranks: str | None, context: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(path, ranks), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: list[list] = [[], [], [], [], []]
                for doc_id, text in zip(*(batch.column(i).slice(at, 256).to_pylist() for i in range(2))):
                    ids = own.ids(text).tobytes() + end
                    tokens, start = len(ids) // 4, 0
                    for n in lengths(tokens, context):
                        for column, value in zip(out, (doc_id, start, n, tokens, ids[4 * start : 4 * (start + n)])):
                            column.append(value)
                        start += n
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (*[pa.int64()] * 4, pa.binary()))], ["doc_id", "start", "length", "doc_tokens", "ids"])
        release()

    return run


def pack(docs: DataFrame, path: str | None = None, ranks: str | None = None, context: int = CONTEXT, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), sequence_id, offset, bucket.

    Null and empty texts are one piece of the end id. Repeated rows and rows without id are packed like any other; other
    columns of ``docs`` are not read. No row is moved between tasks; ``sequence_id`` is unique, dense inside a task. An
    empty table gives no rows.
    """
    if context & (context - 1) or context <= 0:
        raise ValueError("the context must be a power of two")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    pieces = rows.mapInArrow(_cut(path, ranks, context, end_id), _SCHEMA)
    return pieces.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("bucket"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences as Parquet, a folder for each length."""
    pieces.write.partitionBy("bucket").parquet(path)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir)))
