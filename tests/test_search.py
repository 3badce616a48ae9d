"""The gram index finds what a scan finds and reads only its lists."""

import random
import re

import pytest
from pyspark.sql import functions as F

from offerloom.operators import search

WORDS = "gants latex limes gutta ciment fraise masque turbine silicone été ÉTÉ x ab 😀😀a".split()


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 5))) + rng.choice(["", " 12", " ab", " a"]) for _ in range(400)]
    ids = [i * 997 - 3000 if i % 3 else i for i in range(400)]
    return spark.createDataFrame([*zip(ids, texts), (10**12, "gants"), (10**12 + 1, None), (10**12 + 2, ""), (None, "gants")], "id long, text string")


@pytest.fixture(scope="module")
def path(spark, rows, tmp_path_factory):
    found = str(tmp_path_factory.mktemp("index") / "grams")
    search.build(rows, "id", "text", found, 8)
    return found


@pytest.mark.parametrize("query", ["gants", "GANTS l", "ab", "a", "b", "12", "é", "été", "x ", "😀😀", "😀a", "zzz", "gantz", "e g", "silicone gutta", "cim", "ciment", " "])
def test_same_rows_as_a_scan(rows, path, query):
    got = sorted((r.id, r.text) for r in search.search(rows, "id", "text", path, query).collect())
    low = query.lower()
    assert got == sorted((r.id, r.text) for r in rows.collect() if r.id is not None and r.text is not None and low in r.text.lower())


def test_empty_query_and_index(spark, rows, path, tmp_path):
    assert search.search(rows, "id", "text", path, "").count() == rows.count()
    none = rows.limit(0)
    search.build(none, "id", "text", str(tmp_path / "i"), 4)
    assert search.search(none, "id", "text", str(tmp_path / "i"), "gants").count() == 0 and search.search(none, "id", "text", str(tmp_path / "i"), "g").count() == 0


def test_only_parts_of_the_query_are_read(spark, rows, path):
    some = search.lists_of(spark, path, "gan", "gan")
    assert 1 <= some.select("part").distinct().count() <= 2 and spark.read.parquet(f"{path}/parts").count() >= 6
    assert some.filter("gram = 'gan'").count() > 0
    plan = search.candidates(spark, path, "gants")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part", plan) and "PushedFilters: [IsNotNull(gram), EqualTo(gram," in plan


def test_lists_are_bounded_by_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_BITS", 4)
    df = spark.range(200).select("id", F.concat(F.lit("common "), F.col("id").cast("string")).alias("text"))
    search.build(df, "id", "text", str(tmp_path / "i"), 4)
    longest = spark.read.parquet(str(tmp_path / "i" / "lists")).agg(F.max(F.size("places")).alias("n")).first()["n"]
    assert longest == 16
    assert search.search(df, "id", "text", str(tmp_path / "i"), "mmon 19").count() == 11
