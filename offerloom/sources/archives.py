"""Archives of captured pages, read by ranges of bytes that a sorted index of compressed blocks names.

Under an archive's folder lie

* ``records``: files of compressed records, each a page with its head, one behind the other;
* ``index``: files of compressed blocks, each some thousand lines of the captures' index, sorted by key and time;
* ``cluster``: text files with a line per block (its first key and time, file, offset, length, number), sorted within and across files.

``CaptureIndex`` is a data source on the two latter: a filter on ``urlkey`` becomes a binary search in the cluster files, so only the
blocks that can hold the key are planned, and each task reads its range of bytes and nothing else. ``archived_pages`` reads
the records' ranges the same way. Files are reached through Arrow's file systems, so paths of object stores work as local ones do.
"""

from __future__ import annotations

import gzip
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from offerloom.functions import text as tx
from offerloom.plans.lineage import cut
from offerloom.sources.readers import page_of_record

#: Lines of the index in a block, by default as public crawls have them.
BLOCK_LINES = 3_000
#: Bytes of neighbouring blocks that one task reads at most, if a block isn't larger by itself.
TASK_BYTES = 16 << 20
#: Captures are dealt to tasks by file and by pieces of this many bytes, so that a large file is no single task.
PIECE_BYTES = 256 << 20
#: Bytes that a probe of the binary search reads at a time.
PROBE = 4 << 10
CAPTURES = "urlkey string, timestamp string, url string, status string, mime string, filename string, offset bigint, length bigint, block_file string, block_offset bigint"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def read_range(file, offset: int, length: int) -> bytes:
    """Just these bytes; a file that ends before is an error."""
    file.seek(offset)
    data = file.read(length)
    if len(data) != length:
        raise EOFError(f"{len(data)} of {length} bytes at {offset}")
    return data


class SortedLines:
    """A text file whose lines are sorted by their first field, read at a few places only."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def start(self, at: int) -> int:
        """Where the first line begins that begins at or behind ``at``; the size if there is none."""
        if at <= 0:
            return 0
        place = at - 1
        while place < self.size:
            self.file.seek(place)
            found = self.file.read(min(PROBE, self.size - place)).find(b"\n")
            if found >= 0:
                return place + found + 1
            place += PROBE
        return self.size

    def lines(self, at: int) -> Iterator[str]:
        """The lines from a line's start on."""
        rest = b""
        while at < self.size:
            self.file.seek(at)
            data = self.file.read(min(PROBE, self.size - at))
            at += len(data)
            *whole, rest = (rest + data).split(b"\n")
            yield from (line.decode("utf-8", "replace") for line in whole)
        if rest:
            yield rest.decode("utf-8", "replace")

    def key(self, at: int) -> str:
        return next(self.lines(at), "").split("\t")[0]

    def before(self, key: str) -> int | None:
        """Where the last line with a smaller key begins; None if there is none."""
        low, high = 0, self.size
        while low < high:  # the smallest place behind which the first line has no smaller key
            middle = (low + high) // 2
            at = self.start(middle)
            if at >= self.size or self.key(at) >= key:
                high = middle
            else:
                low = middle + 1
        return low - 1 if low else None


@dataclass
class Bounds:
    """Keys that filters leave: from ``low`` on, up to ``high`` (itself only if ``closed``); None is no bound."""

    low: str | None = None
    high: str | None = None
    closed: bool = True

    def at_least(self, key: str) -> None:
        self.low = key if self.low is None else max(self.low, key)

    def at_most(self, key: str, closed: bool) -> None:
        if self.high is None or key < self.high or (key == self.high and not closed):
            self.high, self.closed = key, closed

    def take(self, f: Filter) -> None:
        """Narrow the bounds by a filter on the key; others change nothing."""
        if isinstance(f, EqualTo):
            self.at_least(f.value)
            self.at_most(f.value, True)
        elif isinstance(f, In) and f.value:
            self.at_least(min(f.value))
            self.at_most(max(f.value), True)
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.at_least(f.value)
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            self.at_most(f.value, isinstance(f, LessThanOrEqual))
        elif isinstance(f, StringStartsWith):
            self.at_least(f.value)
            self.at_most(f.value + "\U0010ffff", True)

    def behind(self, key: str) -> bool:
        """Whether a key lies behind the upper bound."""
        return self.high is not None and (key > self.high or (key == self.high and not self.closed))


@dataclass
class Blocks(InputPartition):
    """Neighbouring blocks of one file: where they begin, and the length of each."""

    file: str
    offset: int
    lengths: list[int]


def _cluster_line(line: str) -> tuple[str, str, int, int] | None:
    """Key, file, offset and length of a block's line; None for an incomplete one."""
    parts = line.split("\t")
    try:
        return parts[0], parts[2], int(parts[3]), int(parts[4])
    except (IndexError, ValueError):
        return None


def planned(path: str, bounds: Bounds) -> Iterator[tuple[str, int, int]]:
    """File, offset and length of the blocks that can hold keys within bounds, from the one before the lower bound on."""
    system, folder = opened(f"{path}/cluster")
    infos = system.get_file_info(pafs.FileSelector(folder))
    parts = sorted((i.path, i.size) for i in infos if i.is_file and i.size and not i.base_name.startswith(("_", ".")))
    files = [SortedLines(system.open_input_file(p), size) for p, size in parts]
    first, start = 0, 0
    if bounds.low is not None:
        # the last file that begins before the bound has the block before it
        low, high = 0, len(files)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if files[middle].key(0) < bounds.low else (low, middle)
        first = max(low - 1, 0)
        start = (files[first].before(bounds.low) or 0) if files else 0
    for number, lines in enumerate(files[first:]):
        for line in lines.lines(start if number == 0 else 0):
            block = _cluster_line(line)
            if block is None:
                continue
            if bounds.behind(block[0]):
                return
            yield block[1:]


def _index_rows(text: str, file: str, offset: int) -> Iterator[tuple]:
    """Index lines as rows; a line without its three parts or with a broken object is left out."""
    for line in text.splitlines():
        parts = line.split(" ", 2)
        if len(parts) < 3:
            continue
        try:
            told = json.loads(parts[2])
            number = {k: int(told[k]) if told.get(k) is not None else None for k in ("offset", "length")}
            row = (*parts[:2], *(told.get(k) for k in ("url", "status", "mime", "filename")), number["offset"], number["length"])
        except (ValueError, AttributeError, TypeError):
            continue
        if told.get("url") is not None:
            yield (*(None if x is None else x if isinstance(x, int) else str(x) for x in row), file, offset)


class CaptureIndexReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.strict = options["path"].rstrip("/"), options.get("errors", "skip") == "fail"
        self.task_bytes = int(options.get("task_bytes", TASK_BYTES))
        self.bounds, self.files = Bounds(), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Key filters narrow the blocks, filters on the block's file choose them; rows are filtered again by Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == ("urlkey",):
                self.bounds.take(f)
            elif getattr(f, "attribute", None) == ("block_file",) and isinstance(f, (EqualTo, In)):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.files = named if self.files is None else self.files & named
            yield f

    def partitions(self) -> list[Blocks]:
        out: list[Blocks] = []
        for file, offset, length in planned(self.path, self.bounds):
            if self.files is not None and file not in self.files:
                continue
            last = out[-1] if out else None
            if last and last.file == file and last.offset + sum(last.lengths) == offset and sum(last.lengths) + length <= self.task_bytes:
                last.lengths.append(length)
            else:
                out.append(Blocks(file, offset, [length]))
        return out or [Blocks("", 0, [])]

    def read(self, partition: Blocks) -> Iterator[tuple]:
        if not partition.lengths:
            return
        system, path = opened(f"{self.path}/index/{partition.file}")
        at = partition.offset
        with system.open_input_file(path) as file:
            for length in partition.lengths:
                try:
                    text = gzip.decompress(read_range(file, at, length)).decode("utf-8", "replace")
                except (OSError, EOFError):
                    if self.strict:
                        raise
                    text = ""
                yield from _index_rows(text, partition.file, at)
                at += length


class CaptureIndex(DataSource):
    """Format ``capture_index``: the captures of an archive. Options: path; ``errors`` = skip (broken blocks give no rows) or fail; task_bytes."""

    @classmethod
    def name(cls) -> str:
        return "capture_index"

    def schema(self) -> str:
        return CAPTURES

    def reader(self, schema) -> CaptureIndexReader:
        return CaptureIndexReader(self.options)


def capture_index(spark: SparkSession, path: str, **options) -> DataFrame:
    """The captures of an archive; filters on ``urlkey`` and ``block_file`` reach the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureIndex)
    return spark.read.format("capture_index").options(**{k: str(v) for k, v in options.items()}).load(path)


# pages


def _pages(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = opened(f"{path}/records")
        name, file = None, None
        for batch in batches:
            out: list[list] = [[], [], []]
            wanted = (batch.column(c).to_pylist() for c in ("filename", "offset", "length"))
            for filename, offset, length in zip(*wanted):
                html = error = None
                n_bytes = 0
                try:
                    if filename is None or offset is None or length is None:
                        raise ValueError("no range")
                    if filename != name:
                        name, file = None, system.open_input_file(f"{folder}/{filename.lstrip('/')}")
                        name = filename
                    data = read_range(file, offset, length)
                    n_bytes = len(data)
                    html = page_of_record(data)
                except (OSError, EOFError, ValueError) as e:
                    error = f"{type(e).__name__}: {e}"
                for column, value in zip(out, (html, n_bytes, error)):
                    column.append(value)
            added = [pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "html", "n_bytes", "error"])

    return run


def archived_pages(captures: DataFrame, path: str) -> DataFrame:
    """``captures`` (filename, offset, length, ...) with html, n_bytes (read for it) and error.

    Captures of a piece of a file are read by one task, in order of their places, so a file is opened once for many. A range that
    is null, not there or no record gives a null page and says why; it stops nothing.
    """
    clash = {"html", "n_bytes", "error"} & set(captures.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are made here")
    dealt = captures.repartition("filename", F.floor(F.col("offset") / PIECE_BYTES)).sortWithinPartitions("filename", "offset")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in captures.schema)
    return dealt.mapInArrow(_pages(path), f"{schema}, html string, n_bytes long, error string")


# writing


def _write_records(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = opened(f"{path}/records")
        system.create_dir(folder, recursive=True)
        name, at, sink = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            sink = sink or system.open_output_stream(f"{folder}/{name}", compression=None)
            places: list[list[int]] = [[], []]
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {url}\r\n\r\nHTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                record = gzip.compress(head.encode() + (html or "").encode(), mtime=0)
                sink.write(record)
                places[0].append(at)
                places[1].append(len(record))
                at += len(record)
            kept = [batch.column(c) for c in ("urlkey", "timestamp", "url", "status")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([name] * batch.num_rows), *(pa.array(p, pa.int64()) for p in places)], names=["urlkey", "timestamp", "url", "status", "filename", "offset", "length"])
        if sink:
            sink.close()

    return run


def _write_blocks(path: str, lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = opened(f"{path}/index")
        system.create_dir(folder, recursive=True)
        part, at, sink, number = TaskContext.get().partitionId(), 0, None, 0
        name, waiting = f"cdx-{part:05d}-{uuid.uuid4().hex}.gz", []

        def block() -> tuple:
            nonlocal at, sink, number
            sink = sink or system.open_output_stream(f"{folder}/{name}", compression=None)
            data = gzip.compress("".join(line + "\n" for line in waiting).encode(), mtime=0)
            sink.write(data)
            key, timestamp = waiting[0].split(" ", 2)[:2]
            row = (key, timestamp, name, at, len(data), part, number)
            at, number = at + len(data), number + 1
            waiting.clear()
            return row

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["key", "timestamp", "file", "offset", "length", "part", "number"])

        for batch in batches:
            rows = []
            for line in batch.column("line").to_pylist():
                waiting.append(line)
                if len(waiting) == lines:
                    rows.append(block())
            if rows:
                yield batch_of(rows)
        if waiting:
            yield batch_of([block()])
        if sink:
            sink.close()

    return run


def write_archive(pages: DataFrame, path: str, block_lines: int = BLOCK_LINES, parts: int | None = None) -> None:
    """An archive of ``pages`` (url, timestamp, status, html) under a new folder.

    Each task writes files of its own, under names that no other attempt has, and hands on where its records lie; what an attempt that was
    lost has written is named by no index. Index lines are dealt by ranges of keys, sorted in their tasks and cut into blocks. A null
    page is an empty one; rows without address are left out.
    """
    rows = pages.filter("url is not null").select(tx.surt("url").alias("urlkey"), F.col("timestamp").cast("string").alias("timestamp"), "url", F.col("status").cast("string").alias("status"), "html")
    placed = cut(rows.mapInArrow(_write_records(path), "urlkey string, timestamp string, url string, status string, filename string, offset long, length long"), "placed")
    told = F.to_json(F.struct("url", "status", F.lit("text/html").alias("mime"), "filename", F.col("offset").cast("string").alias("offset"), F.col("length").cast("string").alias("length")))
    lines = placed.select("urlkey", "timestamp", F.concat_ws(" ", "urlkey", "timestamp", told).alias("line"))
    dealt = lines.repartitionByRange(*([parts] if parts else []), "urlkey", "timestamp").sortWithinPartitions("urlkey", "timestamp", "line")
    blocks = dealt.select("line").mapInArrow(_write_blocks(path, block_lines), "key string, timestamp string, file string, offset long, length long, part long, number long")
    blocks = cut(blocks, "blocks")
    line = F.concat_ws("\t", "key", "timestamp", "file", *[F.col(c).cast("string") for c in ("offset", "length", "number")])
    blocks.orderBy("part", "number").select(line.alias("value")).write.text(f"{path}/cluster")
