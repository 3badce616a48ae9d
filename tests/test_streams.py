"""State of streams: changes, restarts in mid-stream, initial tables, late rows."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from offerloom.streaming import ingest, state

SCHEMA = "product string, ts timestamp, price double, availability string"


def frame(spark, rows):
    return spark.createDataFrame(rows, "product string, ts string, price double, availability string").withColumn("ts", F.to_timestamp("ts"))


def write(spark, tmp_path, n, rows):
    frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))


def changes(spark, tmp_path, **more):
    stream = ingest.arriving(spark, str(tmp_path / "in" / "*"), SCHEMA, 1)
    return state.changed_rows(stream, "product", "ts", ["price", "availability"], **more)


def run(spark, tmp_path, **more):
    state.append_changes(changes(spark, tmp_path, **more), str(tmp_path / "out"), str(tmp_path / "done"))


def seen(spark, tmp_path):
    return sorted(((r.product, str(r.ts)[5:10], r.price, r.availability) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=repr)


def test_changes_over_batches_and_runs(spark, tmp_path):
    write(spark, tmp_path, 0, [("p", "2024-01-03", 2.0, "a"), ("p", "2024-01-01", 1.0, "a"), ("p", "2024-01-02", 1.0, "a"), ("q", "2024-01-01", None, None), (None, "2024-01-01", 5.0, None), ("x", None, 1.0, None)])
    run(spark, tmp_path)
    first = [("p", "01-01", 1.0, "a"), ("p", "01-03", 2.0, "a"), ("q", "01-01", None, None), (None, "01-01", 5.0, None)]
    assert seen(spark, tmp_path) == sorted(first, key=repr)
    write(spark, tmp_path, 1, [("p", "2024-01-04", 2.0, "a"), ("q", "2024-01-02", None, "b"), ("p", "2024-01-02", 9.0, "late"), (None, "2024-01-02", 5.0, None)])
    run(spark, tmp_path)
    assert seen(spark, tmp_path) == sorted([*first, ("q", "01-02", None, "b")], key=repr)
    kept = sorted(((r.product, str(r.ts)[5:10], r.price, r.availability) for r in state.current_rows(spark, str(tmp_path / "done")).collect()), key=repr)
    assert kept == sorted([("p", "01-04", 2.0, "a"), ("q", "01-02", None, "b"), (None, "01-02", 5.0, None)], key=repr)
    run(spark, tmp_path)  # nothing new
    assert len(seen(spark, tmp_path)) == 5


def test_initial_table(spark, tmp_path):
    initial = frame(spark, [("p", "2024-01-01", 1.0, "a"), ("p", "2024-01-02", 2.0, "a"), ("r", "2024-01-01", 3.0, "a"), ("s", None, 3.0, "a")])
    write(spark, tmp_path, 0, [("p", "2024-01-03", 2.0, "a"), ("r", "2024-01-02", 4.0, "a"), ("t", "2024-01-01", 1.0, "a")])
    run(spark, tmp_path, initial=initial)
    assert seen(spark, tmp_path) == [("r", "01-02", 4.0, "a"), ("t", "01-01", 1.0, "a")]
    assert {r.product: r.price for r in state.current_rows(spark, str(tmp_path / "done")).collect()} == {"p": 2.0, "r": 4.0, "t": 1.0}


def test_restart_in_mid_stream(spark, tmp_path):
    """A run that breaks after a batch was worked out but before it was done gives every change once when it is run again."""
    rng, batches = random.Random(4), []
    for n in range(4):
        batches.append([(f"k{rng.randrange(6)}", f"2024-01-{10 + n:02d} 00:00:{i:02d}", float(rng.randrange(2)), "a") for i in range(20)])
        write(spark, tmp_path, n, batches[-1])
    broken = []

    def each(batch, number):
        batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"n={number}"))
        if number == 2 and not broken:
            broken.append(number)
            raise RuntimeError("lost")

    with pytest.raises(StreamingQueryException):
        ingest.drain(changes(spark, tmp_path), str(tmp_path / "done"), each)
    ingest.drain(changes(spark, tmp_path), str(tmp_path / "done"), each)
    last, wanted = {}, []
    for key, ts, price, availability in sorted((r for b in batches for r in b), key=lambda r: r[1]):
        if last.get(key) != price:
            wanted.append((key, ts, price))
        last[key] = price
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert broken == [2] and sorted((r.product, str(r.ts), r.price) for r in got) == sorted(wanted)
    assert {r.product: r.price for r in state.current_rows(spark, str(tmp_path / "done")).collect()} == last


def test_keys_share_pages(spark, tmp_path):
    """The state has a row per page, not per key; keys of one page don't mix."""
    for n in range(3):
        spark.range(3000).filter(f"id % 3 <= {n}").selectExpr("concat('k', id) product", f"timestamp '2024-01-01' + make_interval(0, 0, 0, {n}) ts", f"double(id * if(id % 2 = 0, {n}, 1)) price", "'a' availability").coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    run(spark, tmp_path)
    assert spark.read.format("statestore").option("stateVarName", state.LAST).load(str(tmp_path / "done")).count() <= 1024
    kept = {r.product: (str(r.ts)[5:10], r.price) for r in state.current_rows(spark, str(tmp_path / "done")).collect()}
    assert kept == {f"k{i}": ("01-03", float(i * (2 if i % 2 == 0 else 1))) for i in range(3000)}
    first = {0: 0, 1: 1, 2: 2}
    wanted = sum(len({i * (n if i % 2 == 0 else 1) for n in range(first[i % 3], 3)}) for i in range(3000))
    assert spark.read.parquet(str(tmp_path / "out")).count() == wanted


def test_odd_keys_and_values_in_one_page(spark, tmp_path):
    schema = "k double, n long, v struct<a: int, b: array<string>>"
    nan, batches = float("nan"), []
    batches.append([(nan, 1, (1, ["x"])), (nan, 2, (2, None)), (0.0, 1, None), (None, 1, (1, [])), (1.5, None, None), (2.5, 9, (1, ["x", None]))])
    batches.append([(nan, 3, (2, None)), (-0.0, 2, (None, ["y"])), (None, 1, (7, [])), (2.5, 8, None), (3.5, 2**60, None), (2.5, 10, (1, ["x", None]))])
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
        stream = ingest.arriving(spark, str(tmp_path / "in" / "*"), schema, 1)
        state.append_changes(state.changed_rows(stream, "k", "n", ["v"], pages=1), str(tmp_path / "out"), str(tmp_path / "done"))
    shown = lambda df: sorted((str(r.k).replace("-0.0", "0.0"), r.n, r.v and tuple(r.v)) for r in df.collect())
    assert shown(state.current_rows(spark, str(tmp_path / "done"))) == [("0.0", 2, (None, ["y"])), ("2.5", 10, (1, ["x", None])), ("3.5", 2**60, None), ("None", 1, (1, [])), ("nan", 3, (2, None))]
    changes = [("0.0", 1, None), ("0.0", 2, (None, ["y"])), ("2.5", 9, (1, ["x", None])), ("3.5", 2**60, None), ("None", 1, (1, [])), ("nan", 1, (1, ["x"])), ("nan", 2, (2, None))]
    assert shown(spark.read.parquet(str(tmp_path / "out"))) == changes


def test_other_number_of_pages_is_refused(spark, tmp_path):
    write(spark, tmp_path, 0, [("p", "2024-01-01", 1.0, "a")])
    run(spark, tmp_path, pages=1)
    write(spark, tmp_path, 1, [(f"p{n}", "2024-01-02", 1.0, "a") for n in range(50)])
    with pytest.raises(StreamingQueryException, match="begun with 1 pages, not 2"):
        run(spark, tmp_path, pages=2)


def test_keys_with_a_time_to_live(spark, tmp_path):
    """Each key is a page of its own, so one key's rows don't keep another."""
    for n in range(2):
        write(spark, tmp_path, n, [("p", f"2024-01-0{n + 1}", 1.0, "a"), ("p", f"2024-01-0{n + 3}", 2.0, "a"), (f"q{n}", "2024-01-01", float(n), None)])
        sink = changes(spark, tmp_path, ttl_ms=3_600_000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "done"))
        sink.trigger(once=True).start().awaitTermination()  # with clocks, availableNow finds another batch to run each time
    assert seen(spark, tmp_path) == [("p", "01-01", 1.0, "a"), ("p", "01-03", 2.0, "a"), ("q0", "01-01", 0.0, None), ("q1", "01-01", 1.0, None)]
    assert {r.product: r.price for r in state.current_rows(spark, str(tmp_path / "done")).collect()} == {"p": 2.0, "q0": 0.0, "q1": 1.0}
