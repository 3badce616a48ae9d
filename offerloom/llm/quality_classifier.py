"""Quality classifier: nearest neighbours among labelled latent-semantic vectors.

A text becomes counts of terms: hashed words, word shapes, and levels of the measures of its repetition, signs and length.
Inverse document frequencies, counted over all documents, and a truncated singular value decomposition of a bounded labelled
sample project the counts to a short unit vector. The labelled vectors are broadcast; for blocks of documents the cosines with all of them are computed
exactly, and the labels of the nearest are averaged with weights that grow with the cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from offerloom.llm.quality_rules import measure
from offerloom.llm.samples import labelled_sample
from offerloom.llm.texts import WORDS_KEPT, crc32_of_id, table
from offerloom.plans.lineage import cut

#: Most labelled documents, which is also the number of broadcast vectors.
SAMPLE = 4_000
DIMENSIONS, NEIGHBOURS = 64, 15
#: Places to which cosines count; what differs beyond them comes from the order of summing.
DECIMALS = 5
#: Steps of the subspace iteration that finds the singular vectors.
STEPS = 8
#: Hash buckets of words and of word shapes, and levels of each measure.
WORD_TERMS, SHAPE_TERMS, LEVELS = 4096, 256, 8
#: How much the three kinds of terms weigh.
WEIGHTS = (0.15, 1.0, 1.0)
SHARPNESS = 8.0
LEVEL = 0.5
_SHAPE = bytes(0x41 if 65 <= c <= 90 else 0x61 if 97 <= c <= 122 or c >= 128 else 0x30 if 48 <= c <= 57 else c for c in range(256))
_MEASURES = 7
TERMS = WORD_TERMS + SHAPE_TERMS + _MEASURES * LEVELS


class _Terms(dict):
    """Word to its two term numbers as one."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        shape = word.translate(_SHAPE)
        short = bytes(c for i, c in enumerate(shape) if i < 1 or c != shape[i - 1])[:12]
        self[word] = v = xxhash.xxh3_64_intdigest(word.lower()) % WORD_TERMS * SHAPE_TERMS + xxhash.xxh3_64_intdigest(short) % SHAPE_TERMS
        return v


_terms = _Terms()


def _words(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(_terms.__getitem__, words), np.int64, len(words))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's documents hold each word and shape term, and how many there are (as term -1)."""
    n, total, here = np.zeros(WORD_TERMS + SHAPE_TERMS, np.int64), 0, np.zeros(WORD_TERMS + SHAPE_TERMS, bool)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            words = set((text or "").encode("utf-8", "surrogatepass").split())
            both = np.fromiter(map(_terms.__getitem__, words), np.int64, len(words))
            here[:] = False
            here[both // SHAPE_TERMS] = True
            here[WORD_TERMS + both % SHAPE_TERMS] = True
            n += here
            total += 1
    _terms.clear()
    terms = np.flatnonzero(n)
    yield pa.record_batch([pa.array(np.append(terms, -1)), pa.array(np.append(n[terms], total))], ["term", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """The weight of each term by the share of all documents that hold it; levels of measures weigh 1. The driver gets a row per term."""
    rows = docs.select("text").mapInArrow(_held, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    held = {r["term"]: r["n"] for r in rows}
    total, out = held.pop(-1, 0), np.ones(TERMS, np.float32)
    n = np.zeros(WORD_TERMS + SHAPE_TERMS)
    n[list(held)] = list(held.values())
    out[: len(n)] = np.log((1 + total) / (1 + n)) + 0.3
    return out


def counts(text: str | None) -> np.ndarray:
    """The weighted term counts of a text."""
    both = _words(text)
    out = np.zeros(TERMS, np.float32)
    n = max(1, len(both))
    out[:WORD_TERMS] = np.bincount(both // SHAPE_TERMS, minlength=WORD_TERMS) / n
    out[WORD_TERMS : WORD_TERMS + SHAPE_TERMS] = np.bincount(both % SHAPE_TERMS, minlength=SHAPE_TERMS) / n
    n_words, chars, symbols, dup_lines, repeated, lines, letters, capitals, marks, most = measure(text)
    shares = (symbols / n, capitals / max(1, letters), dup_lines / max(1, lines), repeated / n, marks / n, most / max(20, n), np.log10(1 + n_words) / 4)
    for i, share in enumerate(shares):
        out[WORD_TERMS + SHAPE_TERMS + i * LEVELS + min(LEVELS - 1, int(share * LEVELS))] = 1.0
    out[:WORD_TERMS] = np.sqrt(out[:WORD_TERMS]) * WEIGHTS[0]
    out[WORD_TERMS : WORD_TERMS + SHAPE_TERMS] = np.sqrt(out[WORD_TERMS : WORD_TERMS + SHAPE_TERMS]) * WEIGHTS[1]
    out[WORD_TERMS + SHAPE_TERMS :] *= WEIGHTS[2] / np.sqrt(_MEASURES)
    return out


@F.pandas_udf(T.BinaryType())
def _counts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: counts(t).tobytes())


class Model:
    """Projection (terms x dimensions, with the idf), unit vectors of the labelled documents, their labels."""

    def __init__(self, projection: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.projection, self.vectors, self.labels = projection, vectors, labels

    def project(self, x: np.ndarray) -> np.ndarray:
        v = x @ self.projection
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        cosine = self.project(np.stack([counts(t) for t in texts])) @ self.vectors.T
        return vote(np.round(cosine, DECIMALS), self.labels)


def vote(cosine: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weighted share of good labels among the NEIGHBOURS nearest; those that tie for the last places share what places are left."""
    k = min(NEIGHBOURS, cosine.shape[1])
    last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
    tied = cosine == last
    left = k - (cosine > last).sum(1)
    out = np.empty(len(cosine))
    for row, (cosines, level, share) in enumerate(zip(cosine, last[:, 0], left / tied.sum(1))):
        near = np.flatnonzero(cosines >= level)
        weight = np.exp(SHARPNESS * (cosines[near].astype(np.float64) - 1)) * np.where(cosines[near] == level, share, 1.0)
        out[row] = weight @ labels[near] / weight.sum()
    return np.clip(out, 0, 1)


def right_vectors(x: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` right singular vectors, by subspace iteration from a fixed start with some vectors to spare."""
    q = np.random.default_rng(7).standard_normal((x.shape[1], min(x.shape[1], k + 16))).astype(np.float32)
    for _ in range(STEPS):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, small = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ small.T)[:, :k]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample = cut(labelled_sample(docs, labels, "quality", SAMPLE), "sample")
    rows = sample.select("doc_id", "label", _counts("text").alias("terms")).orderBy("doc_id", "terms").limit(SAMPLE).toPandas()
    if not len(rows):
        return Model(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    x = np.stack([np.frombuffer(b, np.float32) for b in rows.terms])
    idf = inverse_frequencies(docs)
    projection = (idf[:, None] * right_vectors(x * idf, min(DIMENSIONS, len(x)))).astype(np.float32)
    model = Model(projection, np.zeros((0, 1), np.float32), rows.label.to_numpy(np.float32))
    model.vectors = model.project(x).astype(np.float32)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (share of good neighbours), predicted.

    Cosines are compared to DECIMALS places; of labelled documents that tie for the last of the NEIGHBOURS places all count, each with its part
    of a place. Null and empty texts are texts without words and are scored by what is like them. Without labelled documents all scores
    are 0.5. Repeated rows are scored each; an empty table gives no rows. Only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            parts = [shared.value.scores(batch.iloc[at : at + 256].tolist()) for at in range(0, len(batch), 256)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    rows = docs.select("doc_id", run("text").alias("score"))
    return rows.select("doc_id", "score", (F.col("score") >= LEVEL).cast("int").alias("predicted"))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc32_of_id() % 3 == 1).alias("held_out"), "score", "predicted")
