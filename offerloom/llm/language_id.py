"""Language identification by prediction by partial matching.

For each language a context tree of orders 0 to ORDER over the text's bytes is counted on a bounded sample. A byte's code
length in a context that saw it is that of c / (n + u), with the count c of the byte, the n bytes and the u distinct bytes seen
there; else the escape u / (n + u) is coded and the next shorter context is asked, down to equal shares of all 256 bytes. The
statistics are frozen, so code lengths are known beforehand for every context and byte that some language has seen; a byte is
looked up once for GROUP languages, and only what none of them has seen is coded escape by escape.

A-Z are lower-cased; all other bytes are kept as they are. All languages code the same bytes, so their code lengths compare.
The language with the shortest code wins.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from offerloom.llm.texts import as_bytes, crc32_of_id, release, table
from offerloom.plans.lineage import broadcast_if, cut

#: Most documents per language, and bytes of all languages together, that the trees are counted on; every language gets the same share
#: of the bytes, and only documents that fit into it whole.
SAMPLE, SAMPLE_BYTES = 2_000, 16_000_000
#: Documents longer than this share of a language's bytes are taken only after all others.
LONG = 8
#: Bytes of the longest context; a context and its byte are one integer.
ORDER = 4
#: Most rows of languages, and of chosen documents, that are broadcast; beyond them the joins are shuffled.
LANGUAGES_BROADCAST, CHOSEN_BROADCAST = 50_000, 2_000_000
#: Languages that share a table of code lengths, and bytes that are looked up at a time.
GROUP, PIECE = 8, 1 << 19
UNDETERMINED = "und"
_MASKS = [(1 << 8 * (k + 1)) - 1 for k in range(ORDER + 1)]
_cache: dict = {}


def training_rows(docs: DataFrame) -> DataFrame:
    """lang and the text's bytes of the sample: documents outside the held-out part, those with the smallest hashes of their ids.

    The numbers of documents per language tell how small the hashes must be: twice the sample passes that filter, so that no
    task orders all documents of a language. Of rows repeated with one id one is taken. The bytes of all languages together stay
    within SAMPLE_BYTES, so what a task counts, the driver gets and the workers hold is bounded. There may be any number of languages;
    the more, the smaller their shares. A language of which no document fits into its share is not learned.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("id"), "lang", F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    known = known.filter(F.col("lang").isNotNull() & (crc32_of_id("id") % 5 != 0)).withColumn("hash", F.xxhash64("id"))
    n_langs = known.select("lang").distinct().count()
    most = SAMPLE_BYTES // max(1, n_langs)
    known = known.filter(F.col("size") <= most)
    langs = cut(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "langs")
    share = langs.select(F.col("lang").alias("l"), F.least(F.lit(1.0), F.lit(2.0 * SAMPLE) / F.col("n")).alias("share"))
    known = known.join(broadcast_if(share, n_langs, LANGUAGES_BROADCAST), F.col("lang") == F.col("l")).filter(F.col("hash") / 2.0**64 + 0.5 <= F.col("share"))
    known = known.groupBy("lang", "id", "hash").agg(F.max("size").alias("size"))
    order = W.partitionBy("lang").orderBy(F.col("size") > most // LONG, "hash", "id")
    before = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1))
    known = known.withColumns({"turn": F.row_number().over(order), "before": F.coalesce(before, F.lit(0))})
    chosen = cut(known.filter((F.col("turn") <= SAMPLE) & (F.col("before") + F.col("size") <= most)).select("lang", "id", "size"), "chosen")
    texts = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("lang").alias("l"), as_bytes().alias("body"))
    same = F.col("i").eqNullSafe(F.col("id")) & (F.col("l") == F.col("lang")) & (F.octet_length("body") == F.col("size"))
    rows = texts.join(broadcast_if(chosen, chosen.count(), CHOSEN_BROADCAST), same).select("lang", "id", "size", "body")
    return rows.groupBy("lang", "id", "size").agg(F.min("body").alias("body")).select("lang", "body")


def _grams(data: bytes) -> np.ndarray:
    """For each byte it and the ORDER bytes before, as one integer with the byte itself lowest."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    out = b.copy()
    for k in range(1, ORDER + 1):
        out[k:] |= b[:-k] << 8 * k
    return out


def _padded(body: bytes) -> Iterator[bytes]:
    """The lower-cased text in pieces, each with the ORDER bytes before it; zeros stand before a text."""
    body = bytes(ORDER) + body.lower()
    for at in range(ORDER, len(body), PIECE):
        yield body[at - ORDER : at + PIECE]


def _text_grams(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of the pieces' own bytes, and where each piece begins among them."""
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    own = np.ones(ends[-1], bool)
    own[(ends - sizes)[:, None] + np.arange(ORDER)] = False
    return _grams(b"".join(pieces))[own], np.cumsum(sizes - ORDER) - (sizes - ORDER)


def _count(group: pd.DataFrame) -> pd.DataFrame:
    """The grams of a language's sample with their numbers."""
    parts = [np.unique(_text_grams([p])[0], return_counts=True) for b in group.body for p in _padded(b)]
    keys, counts = _merged([k for k, _ in parts], [c for _, c in parts])
    return pd.DataFrame({"lang": group.lang.iloc[0], "gram": [keys.astype("<i8").tobytes()], "n": [counts.astype("<i4").tobytes()]})


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, where = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(where, np.concatenate(counts), len(found)).astype(np.int64)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``keys`` are in the sorted ``table``, and whether they are."""
    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


class Tables:
    """Code lengths of up to GROUP languages: per order the grams and the contexts that one of them has seen."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        self.orders = []
        for order in range(ORDER + 1):
            seen = [_merged([k & _MASKS[order]], [n]) for k, n in counts]
            grams = np.unique(np.concatenate([k for k, _ in seen]))
            contexts = np.unique(grams >> 8)
            if order:
                lower = self.orders[-1]
                bits = lower[1][np.searchsorted(lower[0], grams & _MASKS[order - 1])].copy()
            else:
                bits = np.full((len(grams), len(counts)), 8.0, np.float32)
            escapes = np.zeros((len(contexts), len(counts)), np.float32)
            for column, (keys, n) in enumerate(seen):
                of = np.searchsorted(contexts, keys >> 8)
                total, distinct = np.bincount(of, n, len(contexts)), np.bincount(of, minlength=len(contexts))
                some = distinct > 0
                escapes[some, column] = np.log2((total + distinct)[some] / distinct[some])
                bits[:, column] += escapes[np.searchsorted(contexts, grams >> 8), column]
                bits[np.searchsorted(grams, keys), column] = np.log2((total + distinct)[of] / n)
            self.orders.append((grams, bits, contexts, escapes))
        self.width = len(counts)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte, a column per language."""
        out = np.zeros((len(grams), self.width), np.float32)
        rest = np.arange(len(grams))
        for order in range(ORDER, -1, -1):
            known, bits, contexts, escapes = self.orders[order]
            keys = grams[rest] & _MASKS[order]
            at, hit = _find(known, keys)
            out[rest[hit]] += bits[at[hit]]
            rest, keys = rest[~hit], keys[~hit]
            at, hit = _find(contexts, keys >> 8)
            out[rest[hit]] += escapes[at[hit]]
        out[rest] += 8.0
        return out


class Model:
    """Per language the grams of the longest order and their numbers; shorter ones are their sums."""

    def __init__(self, counts: dict[str, tuple[bytes, bytes]]):
        self.langs, self.key = sorted(counts), uuid.uuid4().hex
        self.counts = [tuple(np.frombuffer(x, kind) for x, kind in zip(counts[lang], ("<i8", "<i4"))) for lang in self.langs]

    def tables(self) -> list[Tables]:
        return [Tables(self.counts[at : at + GROUP]) for at in range(0, len(self.counts), GROUP)]


def fit(docs: DataFrame) -> Model:
    """Count the trees, a task per language of bounded bytes. The driver gets the distinct grams of the bounded samples."""
    rows = training_rows(docs)
    return Model({r["lang"]: (bytes(r["gram"]), bytes(r["n"])) for r in rows.groupBy("lang").applyInPandas(_count, "lang string, gram binary, n binary").collect()})


def text_bits(bodies: list[bytes], tables: list[Tables]) -> np.ndarray:
    """Code length of each text in each language."""
    total = np.zeros((len(bodies), sum(t.width for t in tables)))
    pieces = [(i, p) for i, b in enumerate(bodies) for p in _padded(b)]
    while pieces:
        n, size = 0, 0
        while n < len(pieces) and size < PIECE:
            size += len(pieces[n][1])
            n += 1
        some, pieces = pieces[:n], pieces[n:]
        grams, starts = _text_grams([p for _, p in some])
        # words repeat, so every distinct gram is looked up once
        distinct, where = np.unique(grams, return_inverse=True)
        column = 0
        for t in tables:
            bits = t.bits(distinct)[where]
            np.add.at(total[:, column : column + t.width], [i for i, _ in some], np.add.reduceat(bits, starts, 0, dtype=np.float64))
            column += t.width
    return total


def _identify(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        if _cache.get("key") != own.key:
            _cache.update(key=own.key, tables=own.tables())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = [t or "" for t in batch.column(1).slice(at, 256).to_pylist()]
                letters = [any(map(str.isalpha, t)) for t in texts]
                found, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                if own.langs and any(letters):
                    total = text_bits([t.encode("utf-8", "surrogatepass") if ok else b"" for t, ok in zip(texts, letters)], _cache["tables"])
                    # of equal lengths the first language by code point
                    best = total.argmin(1)
                    shares = 1 / np.exp2(np.maximum(-1000, total.min(1, keepdims=True) - total)).sum(1)
                    for i in np.flatnonzero(letters):
                        found[i], scores[i] = own.langs[best[i]], shares[i]
                yield pa.record_batch([batch.column(0).slice(at, 256), pa.array(found), pa.array(scores)], ["doc_id", "lang_pred", "score"])
        release()

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (the share of the best language when code lengths are likelihoods).

    Texts that are null, empty or without a letter are ``und`` with score 0, as is all if no language was learned. Of languages
    with equal code lengths the first by code point wins. Repeated rows are judged each; an empty table gives no rows. Only
    doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_identify(shared), "doc_id long, lang_pred string, score double")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    found = identify(docs, fit(docs))
    return found.select("doc_id", (crc32_of_id() % 5 == 0).alias("held_out"), "lang_pred", "score")
