"""Runs of words that repeat with a period, by a harmonic grid of places.

For a period p the places 0, p, 2p, ... form a grid; over all periods up to a quarter of the words these are about n ln n pairs
of neighbouring grid places. From the first grid place in a run that holds its period four times on, at least two more periods
agree with those before them, so the first probe keeps the pairs that agree so far, and of neighbouring ones the first. How far their agreement
goes to both sides is found by binary search in prefix hashes, for all pairs at once. Words then confirm every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from offerloom.llm.texts import WORD, crc32_of_id, release, slices, table

#: A run has at least so many words and so many periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Most pairs of places that are looked at together.
PAIRS = 1 << 20
#: The prefix hashes are sums modulo this prime, so that products stay within 64 bits.
PRIME = (1 << 31) - 1


class Collision(Exception):
    """Stretches with equal hashes were not equal."""


@lru_cache(4)
def _powers(base: int, bits: int) -> np.ndarray:
    """The first 2 ** bits powers of a base."""
    powers = np.ones(1, np.int64)
    for k in range(bits):
        powers = np.concatenate((powers, powers * pow(base, 1 << k, PRIME) % PRIME))
    return powers


class Prefixes:
    """Sums of word numbers times powers of a base: equal stretches have equal sums but for the power of their distance."""

    def __init__(self, ids: np.ndarray, attempt: int):
        base = pow(48271, 2 * attempt + 5, PRIME)
        self.powers = _powers(base, max(10, len(ids).bit_length()))
        self.sums = np.concatenate((np.zeros(1, np.int64), np.cumsum((ids + 1) % PRIME * self.powers[: len(ids)] % PRIME))) % PRIME

    def equal(self, at: np.ndarray, apart: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from ``at`` have the hash of those ``apart`` further on."""
        s = self.sums
        here, there = s[at + n] - s[at], s[at + apart + n] - s[at + apart]
        return (here * self.powers[apart] - there) % PRIME == 0


def _grid(n: int, most: int, periods: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods: all multiples of p that leave room for ``periods`` - 1 more periods, some periods at a time."""
    p = np.arange(1, most + 1)
    counts = (n - (periods - 1) * p) // p + 1
    ends = np.cumsum(counts)
    first = 0
    while first < most:
        last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")), first + 1)
        period = np.repeat(p[first:last], counts[first:last])
        begins = np.repeat(ends[first:last] - counts[first:last], counts[first:last])
        yield (np.arange(ends[last - 1] - len(period), ends[last - 1]) - begins) * period, period
        first = last


def _longest(prefixes: Prefixes, low: np.ndarray, high: np.ndarray, at, apart: np.ndarray) -> np.ndarray:
    """For each pair the largest length between ``low`` and ``high`` at which ``at`` (of lengths and pairs) agrees."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_] + 1) >> 1
        same = prefixes.equal(at(open_, middle), apart[open_], middle)
        low[open_[same]], high[open_[~same]] = middle[same], middle[~same] - 1
        open_ = open_[low[open_] < high[open_]]
    return low


def _stretches(ids: np.ndarray, periods: int, attempt: int) -> np.ndarray:
    """Start, length and period of the stretches that hold ``periods`` - 1 periods from a grid place on, by start, length and period."""
    n, prefixes, found = len(ids), Prefixes(ids, attempt), [np.zeros((0, 3), np.int64)]
    for at, period in _grid(n, n // periods, periods):
        first = ids[at] == ids[at + period]
        at, period = at[first], period[first]
        block = (periods - 2) * period
        same = prefixes.equal(at, period, block)
        at, period, block = at[same], period[same], block[same]
        if not len(at):
            continue
        # passing places that are neighbours lie in one stretch, so the first stands for them
        lead = np.flatnonzero(np.concatenate(([True], (period[1:] != period[:-1]) | (at[1:] != at[:-1] + period[1:]))))
        reach = (at + block + period)[np.append(lead[1:], len(at)) - 1]
        at, period, block = at[lead], period[lead], block[lead]
        after = _longest(prefixes, block, n - at - period, lambda i, _: at[i], period)  # noqa: B023  called at once
        before = _longest(prefixes, np.zeros_like(at), at, lambda i, length: at[i] - length, period)  # noqa: B023
        if (at + period + after < reach).any():
            raise Collision
        found.append(np.stack((at - before, before + after + period, period), axis=1))
    rows = np.concatenate(found)
    return rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]


def _confirmed(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of each stretch the row with its smallest period, found equal by the words themselves."""
    kept, at, smallest = [], None, 0
    for start, length, period in rows.tolist():
        if at == (start, length) and period % smallest == 0:
            continue  # a multiple of a period that holds
        end = start + length
        if not np.array_equal(ids[start : end - period], ids[start + period : end]):
            raise Collision
        if at != (start, length):
            kept.append((start, length, period))
            at, smallest = (start, length), period
    return np.array(kept, np.int64).reshape(-1, 3)


def find_runs(ids: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """Rows of start, length and smallest period, by start and period. ``ids`` are equal just where words are.

    Hashes never part equal stretches; where they join others, the words show it and another base is taken.
    """
    if len(ids) < max(min_words, min_periods):
        return np.zeros((0, 3), np.int64)
    for attempt in count():
        try:
            rows = _confirmed(ids, _stretches(ids, min_periods, attempt))
            break
        except Collision:
            continue
    rows = rows[(rows[:, 1] >= min_words) & (rows[:, 1] >= min_periods * rows[:, 2])]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def collapsed(words: list, runs: np.ndarray) -> list:
    """The words that no run holds behind its first period."""
    if not len(runs):
        return words
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0)]


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest length by period; of equal ones the first."""
    if not len(runs):
        return None
    rough = runs[:, 1] / runs[:, 2]
    near = runs[rough >= rough.max() * (1 - 1e-9)].tolist()
    return max(near, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))


def _find(min_words: int, min_periods: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, text in slices(batches):
            out: list[list] = [[] for _ in range(5)]
            for i, t in zip(doc_id, text):
                words = t.split()  # of bytes: cuts at just the six ASCII white spaces
                numbers: dict[bytes, int] = {}
                ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                runs = find_runs(ids, min_words, min_periods)
                best = strongest(runs)
                fields = ("start", "length", "period")
                values = (i, len(words), [dict(zip(fields, r)) for r in runs.tolist()], best and dict(zip(fields, best)), b" ".join(collapsed(words, runs)).decode())
                for column, value in zip(out, values):
                    column.append(value)
            one = pa.struct([(f, pa.int64()) for f in ("start", "length", "period")])
            types = (pa.int64(), pa.int64(), pa.list_(one), one, pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "n_words", "runs", "strongest", "collapsed"])
        release()

    return run


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """One row per document: doc_id, n_words, runs, strongest, collapsed.

    ``runs`` is an array of start (word number), length and period by start and period: the stretches whose smallest period
    fits ``min_periods`` times (3 at least), of ``min_words`` words or more, that no neighbouring word extends. ``strongest`` is the
    run with the greatest exact length by period, of equal ones the first; null without runs. ``collapsed`` are the words outside
    runs and the first periods of runs, joined by one space. Null and empty texts have no words. Repeated rows and rows without
    id count like any other; other columns are not read; no row moves between tasks; an empty table gives no rows.
    """
    if min_periods < 3:
        raise ValueError("a period must fit three times or more")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    one = "struct<start:bigint,length:bigint,period:bigint>"
    return rows.mapInArrow(_find(min_words, min_periods), f"doc_id long, n_words long, runs array<{one}>, strongest {one}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the tail of one text in ten repeats one of its own stretches of words; ids choose text, place and period."""
    h = crc32_of_id()
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), h.alias("h"))
    rows = rows.select("doc_id", "text", "h", F.when(F.col("h") % 10 == 0, words).alias("w"))
    g, n = F.floor(F.col("h") / 10), F.size("w")
    rows = rows.select("doc_id", "text", "w", F.when(n > 0, n).alias("n"), g.alias("g")).withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))

    def word(i: Column) -> Column:
        return F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))

    repeated = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), word), " ")
    return rows.select("doc_id", F.when(F.col("n").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    best = F.col("strongest")
    lines = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.start.alias("start"), best.length.alias("length"), best.period.alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return digest(periodic_runs(planted(table(spark, sf_dir))))
