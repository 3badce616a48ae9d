"""Writers of catalogues and reports."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from offerloom.plans.lineage import cut
from offerloom.sources.archives import opened


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """With header; texts that hold quotes are quoted and doubled. ``mark`` puts a byte-order mark at the start of each file."""
    rows = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]) if mark else df
    rows.write.mode("overwrite").option("escape", '"').csv(path, header=True)


def json_and_csv(df: DataFrame, path: str) -> None:
    """Both exports of a catalogue; the CSV with a byte-order mark, as spreadsheets want it."""
    json_lines(df, f"{path}/json")
    csv(df, f"{path}/csv", mark=True)


def payload(df: DataFrame, path: str, counters: dict[str, Column]) -> None:
    """A catalogue with a head of counters: ``head`` has one row, ``products`` the rows."""
    json_lines(df.agg(F.count(F.lit(1)).alias("count"), *[c.alias(name) for name, c in counters.items()]), f"{path}/head")
    json_lines(df, f"{path}/products")


def url_list(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def run_partition(offers: DataFrame, runs: str, table: str, run_id: int) -> None:
    """A run's offers in a partition of the table and its number of rows in the table of runs."""
    offers.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(table)
    counted = offers.sparkSession.read.parquet(table).filter(F.col("run_id") == run_id).groupBy("run_id").agg(F.count(F.lit(1)).alias("item_count"))
    counted.withColumn("finished_at", F.current_timestamp()).write.mode("append").parquet(runs)


def script(df: DataFrame, name: str, path: str, most: int = 100_000) -> None:
    """A script that assigns the rows to a variable, one row per line, in one file for a page; more than ``most`` rows are refused."""
    if (n := df.limit(most + 1).count()) > most:
        raise ValueError(f"{n} rows or more are too many for a script; at most {most}")
    rows = df.select(F.lit(1).alias("part"), F.concat(F.to_json(F.struct(*df.columns)), F.lit(",")).alias("value"))
    head = df.sparkSession.createDataFrame([(0, f"window.{name}=["), (2, "];")], "part int, value string")
    head.unionByName(rows).coalesce(1).sortWithinPartitions("part").select("value").write.mode("overwrite").text(path)


def page_files(pages: DataFrame, name: str, html: str, path: str) -> DataFrame:
    """A file per page under a folder, ``name``.html, where slashes in the name are folders; returns name and n_bytes of each.

    Files are written to a name of their own and moved, so one that is there is whole, also when a task is run again. Null pages are empty.
    """
    rows = pages.select(F.col(name).cast("string").alias("name"), F.coalesce(F.col(html), F.lit("")).alias("html")).filter("name is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = opened(path)
        for batch in batches:
            sizes = []
            for n, text in zip(batch.column("name").to_pylist(), batch.column("html").to_pylist()):
                target, data = f"{folder}/{n}.html", text.encode()
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}"
                with system.open_output_stream(part, compression=None) as sink:
                    sink.write(data)
                system.move(part, target)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(sizes, pa.int64())], names=["name", "n_bytes"])

    return cut(rows.mapInArrow(run, "name string, n_bytes long"), "page_files")
