"""The archive source: only the blocks and bytes that are asked for are read, broken ones stop nothing."""

import bisect
import glob
import gzip
import hashlib
import io
import os
import random

import pytest
from conftest import SF
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual, StringStartsWith

from offerloom.functions import text as tx
from offerloom.queries import QUERIES
from offerloom.sources import archives
from offerloom.sources.archives import Bounds, CaptureIndexReader, SortedLines, planned, read_range


class Counting(io.BytesIO):
    n_read = 0

    def read(self, n=-1):
        data = super().read(n)
        self.n_read += len(data)
        return data


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("archive") / "a")
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("url", F.lit("20240101000000").alias("timestamp"), F.lit("200").alias("status"), "html")
    more = spark.range(3000).select(F.concat(F.lit("https://www.shop.example/p/"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("url"), F.lit("2024").alias("timestamp"), F.lit("200").alias("status"), F.concat(F.lit("<p>été "), "id").alias("html"))
    archives.write_archive(pages.unionByName(more), path, 50, 4)
    return path


def reader(path, *filters, **options):
    out = CaptureIndexReader({"path": path, "task_bytes": "1"} | options)
    assert list(out.pushFilters(list(filters))) == list(filters)  # rows are filtered again
    return out


def rows_of(r):
    return [row for p in r.partitions() for row in r.read(p)]


def test_sorted_lines_equal_bisect():
    rng = random.Random(3)
    for n in (0, 1, 2, 50, 3000):
        keys = sorted(rng.choice("abc") * rng.randrange(1, 4) + str(rng.randrange(n + 1)) for _ in range(n))
        lines = [f"{k}\t2024\tf\t{i}\t9\t1" + "x" * rng.randrange(300) for i, k in enumerate(keys)]
        data = "".join(line + "\n" for line in lines).encode()
        starts = [0]
        for line in lines:
            starts.append(starts[-1] + len(line) + 1)
        for key in [*keys[:40], "", "a", "b1", "zz"]:
            file = Counting(data)
            at = bisect.bisect_left(keys, key) - 1
            assert SortedLines(file, len(data)).before(key) == (starts[at] if at >= 0 else None)
            assert n < 3000 or file.n_read < 40 * 2 * archives.PROBE + 4096  # a probe for each halving, not the file


def test_only_the_blocks_of_a_key_are_read(archive):
    whole = reader(archive)
    every = rows_of(whole)
    assert len(every) == len({r[2] for r in every}) >= 3000 and [r[0] for r in every] == sorted(r[0] for r in every)
    n_blocks = len(whole.partitions())
    assert n_blocks > 50
    key = "example,shop)/p/01234"
    one = reader(archive, EqualTo(("urlkey",), key))
    assert len(one.partitions()) <= 2 and [r for r in rows_of(one) if r[0] == key] == [r for r in every if r[0] == key]
    for filters, holds in (
        ([GreaterThanOrEqual(("urlkey",), "example,shop)/p/00100"), LessThan(("urlkey",), "example,shop)/p/00250")], lambda k: "example,shop)/p/00100" <= k < "example,shop)/p/00250"),
        ([GreaterThan(("urlkey",), "example,shop)/p/02990")], lambda k: k > "example,shop)/p/02990"),
        ([LessThanOrEqual(("urlkey",), every[20][0])], lambda k: k <= every[20][0]),
        ([StringStartsWith(("urlkey",), "example,shop)/p/002")], lambda k: k.startswith("example,shop)/p/002")),
        ([In(("urlkey",), ("example,shop)/p/00007", "example,shop)/p/00120"))], lambda k: k in ("example,shop)/p/00007", "example,shop)/p/00120")),
        ([EqualTo(("urlkey",), "zz")], lambda k: False),
        ([EqualTo(("status",), "404")], lambda k: True),
    ):
        some = reader(archive, *filters)
        found = rows_of(some)
        assert [r for r in found if holds(r[0])] == [r for r in every if holds(r[0])]
        assert filters[0].attribute == ("status",) or len(some.partitions()) <= 2 + sum(holds(r[0]) for r in every) // 50 + 4
    file = whole.partitions()[0].file
    assert {r[8] for r in rows_of(reader(archive, EqualTo(("block_file",), file)))} == {file}
    assert len(reader(archive, task_bytes=str(1 << 30)).partitions()) == len({p.file for p in whole.partitions()})


def test_filters_reach_the_source(spark, archive):
    df = archives.capture_index(spark, archive, task_bytes=1)
    assert df.rdd.getNumPartitions() > 50
    some = df.filter("urlkey >= 'example,shop)/p/00100' and urlkey < 'example,shop)/p/00250'")
    assert some.rdd.getNumPartitions() <= 7 and some.count() == 150
    assert df.filter("startswith(urlkey, 'example,shop)/p/0000')").count() == 10
    assert df.filter("urlkey = 'nothing'").count() == 0


def test_pages_by_ranges(spark, archive):
    found = archives.capture_index(spark, archive).filter("urlkey >= 'example,shop)/p/00100' and urlkey < 'example,shop)/p/00250'")
    rows = archives.archived_pages(found, archive).collect()
    assert len(rows) == 150 and {r.html for r in rows} == {f"<p>été {i}" for i in range(100, 250)}
    assert sum(r.n_bytes for r in rows) == sum(r.length for r in rows) and {r.error for r in rows} == {None}
    total = sum(os.path.getsize(f) for f in glob.glob(f"{archive}/records/*"))
    assert sum(r.n_bytes for r in rows) < total / 10


def test_broken_ranges_and_blocks_are_told(spark, archive, tmp_path):
    ok = archives.capture_index(spark, archive).limit(1).collect()[0]
    schema = "filename string, offset long, length long, note string"
    wanted = [(ok.filename, ok.offset, ok.length, "ok"), (ok.filename, ok.offset + 1, ok.length, "shifted"), (ok.filename, 10**9, 5, "behind the end"), ("gone.gz", 0, 5, "no file"), (None, None, None, "null")]
    got = {r.note: r for r in archives.archived_pages(spark.createDataFrame(wanted, schema), archive).collect()}
    assert got["ok"].error is None and got["ok"].html and len(got) == 5
    assert all(got[k].html is None and got[k].error for k in got if k != "ok")
    assert archives.archived_pages(spark.createDataFrame([], schema), archive).count() == 0
    with pytest.raises(ValueError):
        archives.archived_pages(spark.createDataFrame([("f", 0, 1, "x")], "filename string, offset long, length long, html string"), archive)
    for folder in ("index", "cluster"):
        os.makedirs(tmp_path / folder)
    good = gzip.compress(b'a 1 {"url": "u", "offset": "3", "length": null}\nb 2 broken\nc\nd 3 [1]\n')
    (tmp_path / "index" / "f").write_bytes(good + b"no gzip!")
    (tmp_path / "cluster" / "part-0").write_text(f"a\t1\tf\t0\t{len(good)}\t0\nbroken\nb\t2\tf\t{len(good)}\t8\t1\n")
    assert rows_of(reader(str(tmp_path))) == [("a", "1", "u", None, None, None, 3, None, "f", 0)]
    with pytest.raises(OSError):
        rows_of(reader(str(tmp_path), errors="fail"))
    with pytest.raises(EOFError):
        read_range(io.BytesIO(b"abc"), 1, 5)


def test_empty_archive(spark, tmp_path):
    path = str(tmp_path / "a")
    archives.write_archive(spark.createDataFrame([(None, "1", "200", "x")], "url string, timestamp string, status string, html string"), path)
    assert list(planned(path, Bounds())) == []
    assert archives.capture_index(spark, path).count() == 0 and archives.capture_index(spark, path).filter("urlkey > 'a'").count() == 0


def test_surt(spark):
    rows = [("https://www.Shop.fr/A/b?Q=1#x", "fr,shop)/a/b?q=1"), ("http://shop.fr", "fr,shop)/"), ("http://shop.fr:8080?x", "fr,shop)/?x"), ("http://www2.a.b.c/", "c,b,a)/")]
    got = spark.createDataFrame(rows, "u string, k string").select(tx.surt("u").alias("got"), "k").collect()
    assert [r.got for r in got] == [r.k for r in got]


def test_pages_of_one_address_are_told_apart(spark, tmp_path):
    rows = [(i, f"https://www.shop.example/{i // 3}", f"<p>page {i}</p>") for i in range(31)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.timestamp, r.html_md5) for r in QUERIES["archived_page_of_url"](spark, str(tmp_path)).collect()}
    assert got == {i: (None, None) if i % 10 == 0 else ("20240301000000", hashlib.md5(html.encode()).hexdigest()) for i, _, html in rows}
