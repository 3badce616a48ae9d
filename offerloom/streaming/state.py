"""The last row of each key as the state of a stream: what changes comes out, and the state itself is the current table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DataType, IntegerType, StructField, StructType

from offerloom.operators.ranking import last_wins

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The name of the state's variable.
LAST = "last"
#: The column of a row's page.
_PAGE = "__page"
#: The number of pages, in each page's state.
_PAGES = "__pages"
#: A task deals so many rows to pages at once.
_DEALT = 100_000


def _same_zone(value):
    """A point in time as UTC: rows bring it with a zone, the state gives it back in local time without one."""
    return value.astimezone(timezone.utc) if isinstance(value, datetime) else value


def pages_for(keys: int) -> int:
    """How many pages serve so many keys: a page holds about 128 of them, and small tables still spread over many tasks."""
    return max(256, keys // 128)


def _plain(key):
    """A key as a Python dictionary can find it: not-a-numbers are one key, as in Spark, and nested values are made of tuples."""
    if isinstance(key, float) and key != key:
        return "NaN", None
    if isinstance(key, dict):
        return tuple((k, _plain(v)) for k, v in key.items())
    return tuple(map(_plain, key)) if isinstance(key, (list, tuple)) else key


def _open(value):
    """A value of the state as the stream brings it: structs as dictionaries."""
    if isinstance(value, Row):
        return {k: _open(v) for k, v in value.asDict().items()}
    return [_open(v) for v in value] if isinstance(value, list) else value


def _columns(schema: StructType) -> StructType:
    """Rows of ``schema`` as one row: an array per column."""
    return StructType([StructField(f.name, ArrayType(f.dataType)) for f in schema])


def _rows(columns: DataFrame, names: Sequence[str], at: str = "") -> DataFrame:
    """The opposite of ``_columns``; the arrays may be fields of the struct ``at``."""
    return columns.select(F.inline(F.arrays_zip(*[F.col(f"{at}`{c}`").alias(c) for c in names])))


def _dealt(rows: DataFrame, page: DataType) -> DataFrame:
    """The rows of each task by page, a row with arrays for each page among up to ``_DEALT`` rows."""
    names = [c for c in rows.columns if c != _PAGE]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= _DEALT:
                yield one(held)
                held, n = [], 0
        if n:
            yield one(held)

    def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held)
        pages = whole[_PAGE].to_numpy()
        order = np.argsort(pages, kind="stable")
        pages, whole = pages[order], whole.take(pa.array(order)).combine_chunks()
        begins = np.flatnonzero(np.r_[True, pages[1:] != pages[:-1]])
        offsets = pa.array(np.r_[begins, len(pages)].astype("int32"))
        lists = [pa.ListArray.from_arrays(offsets, whole[c].chunk(0)) for c in names]
        return pa.RecordBatch.from_arrays([pa.array(pages[begins]), *lists], names=[_PAGE, *names])

    return rows.mapInArrow(deal, StructType([StructField(_PAGE, page), *_columns(rows.select(*names).schema)]))


class LastRows(StatefulProcessor):
    """Keeps the rows with the highest ``seq`` of a page's keys and gives back the rows that differ from their key's one before in a watched column.

    A page's rows come, are kept and go as one row with an array per column, so a batch costs a few messages per page, not per key.
    Rows of a batch are taken in order of ``seq``. A row whose ``seq`` is not above that of the key's last one comes late and changes
    nothing. Without watched columns every row that becomes the last one comes out.
    """

    def __init__(self, schema: StructType, key: str, seq: str, watched: Sequence[str], pages: int, ttl_ms: int | None):
        self.names, self.kept = schema.names, _columns(schema).add(_PAGES, IntegerType())
        self.key, self.seq, self.watched = self.names.index(key), self.names.index(seq), [self.names.index(c) for c in watched]
        self.pages, self.ttl_ms = pages, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState(LAST, self.kept, self.ttl_ms) if self.ttl_ms else handle.getValueState(LAST, self.kept)

    def _kept(self) -> list[list]:
        """The page's last rows, a list per column."""
        kept = self.last.get()
        if kept is None:
            return [[] for _ in self.names]
        if kept[-1] != self.pages:
            raise ValueError(f"the checkpoint was begun with {kept[-1]} pages, not {self.pages}")
        return [_open(list(c)) for c in kept[:-1]]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, moved, out = self._kept(), False, []
        at = {_plain(k): n for n, k in enumerate(last[self.key])}
        seqs = [_same_zone(s) for s in last[self.seq]]
        came = [(_same_zone(r[self.seq]), r) for columns in rows for r in zip(*(columns[c] for c in self.names))]
        for turn, row in sorted(came, key=lambda r: r[0]):
            name = _plain(row[self.key])
            n = at.get(name)
            if n is None:
                at[name] = len(seqs)
                seqs.append(turn)
                for column, value in zip(last, row):
                    column.append(value)
                out.append(row)
            elif turn > seqs[n]:
                if not self.watched or any(_same_zone(row[c]) != _same_zone(last[c][n]) for c in self.watched):
                    out.append(row)
                seqs[n] = turn
                for column, value in zip(last, row):
                    column[n] = value
            else:
                continue
            moved = True
        if moved:
            self.last.update((*last, self.pages))
        if out:
            yield Row(*self.names)(*map(list, zip(*out)))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.last.update((*(initialState[c] for c in self.names), self.pages))

    def close(self) -> None:
        pass


def changed_rows(stream: DataFrame, key: str, seq: str, watched: Sequence[str] = (), initial: DataFrame | None = None, ttl_ms: int | None = None, pages: int = 1024) -> DataFrame:
    """The stream of rows that change a key's last row in one of ``watched``, and each key's first row.

    The state is kept by RocksDB, so it is bounded by disk, not by memory. Keys are dealt by hash to ``pages`` pages, which are read and
    written whole: a batch costs the pages of its own keys. ``pages_for`` tells how many to take; a checkpoint keeps the number it was
    begun with, another one is refused. ``initial`` is a batch table with which the first run of a checkpoint begins; of several rows of
    a key the last one counts. Keys that have not come for ``ttl_ms`` are forgotten; then each key is a page of its own. Rows without
    ``seq`` are left out; a null key is a key. Of a page one batch's rows are sorted in memory, so the files of a batch bound what a
    frequent key costs.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    names, kept = stream.columns, _columns(stream.schema)
    page = F.col(f"`{key}`") if ttl_ms else F.pmod(F.xxhash64(f"`{key}`"), F.lit(pages)).cast("int")
    known = stream.filter(f"`{seq}` is not null").withColumn(_PAGE, page)
    begun = None
    if initial is not None:
        first = last_wins(initial.select(*names).filter(f"`{seq}` is not null"), [key], [seq]).withColumn(_PAGE, page)
        first = first.groupBy(_PAGE).agg(F.collect_list(F.struct(*names)).alias("rows"))
        begun = first.select(_PAGE, *[F.col(f"rows.`{c}`").alias(c) for c in names]).groupBy(_PAGE)
    dealt = known.select(_PAGE, *[F.array(f"`{c}`").alias(c) for c in names]) if ttl_ms else _dealt(known, known.schema[_PAGE].dataType)
    keeper = LastRows(stream.schema, key, seq, watched, 0 if ttl_ms else pages, ttl_ms)
    out = dealt.groupBy(_PAGE).transformWithState(keeper, kept, "Append", "ProcessingTime" if ttl_ms else "None", begun)
    return _rows(out, names)


def current_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The last row of every key, from the state of a stopped stream of ``changed_rows``."""
    state = spark.read.format("statestore").option("stateVarName", LAST).load(checkpoint)
    value = state.schema["value"].dataType
    at = "value.value." if "ttlExpirationMs" in value.names else "value."
    if at != "value.":
        value = value["value"].dataType
    return _rows(state, [c for c in value.names if c != _PAGES], at)


def append_changes(changes: DataFrame, path: str, checkpoint: str) -> None:
    """Write what changes as Parquet, each change once whatever fails on the way, until all that is there is worked off."""
    changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
