"""Tiered keys, duplicate groups and set insertion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from offerloom.functions.text import is_set
from offerloom.operators.ranking import first_wins


def tiered_key(tiers: Sequence[Sequence[str | Column]]) -> Column:
    """The first tier whose columns are all set, as a text that starts with the tier's number; null without any."""
    out = None
    for number, tier in enumerate(tiers, 1):
        columns = [F.col(c) if isinstance(c, str) else c for c in tier]
        here = columns[0].isNotNull() & (columns[0].cast("string") != "")
        for c in columns[1:]:
            here = here & is_set(c)
        key = F.concat_ws("\x1f", F.lit(str(number)), *[c.cast("string") for c in columns])
        out = F.when(here, key) if out is None else out.when(here, key)
    return out


def tiered_dedup(df: DataFrame, tiers: Sequence[Sequence[str | Column]], seq: Sequence[str]) -> DataFrame:
    """First row of each tiered key; rows without any key all stay."""
    keyed = df.withColumn("__key", tiered_key(tiers))
    return first_wins(keyed.filter("__key is not null"), ["__key"], seq).unionByName(keyed.filter("__key is null")).drop("__key")


def duplicate_members(df: DataFrame, kinds: dict[str, Column], member: str) -> DataFrame:
    """kind, key, n, member: a row for each member of a key that two or more rows share, for each kind of key.

    A key of very many members stays many rows: their number is joined to them, nothing is gathered.
    """
    parts = [df.select(F.lit(kind).alias("kind"), key.cast("string").alias("key"), F.col(member).alias("member")) for kind, key in kinds.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.filter((F.col("key") != "") & F.col("key").isNotNull())
    large = rows.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(large, ["kind", "key"]).select("kind", "key", "n", "member")


def with_duplicate_flags(df: DataFrame, kinds: dict[str, Column], member: str, flags: str) -> DataFrame:
    """``df`` with ``duplicate_<kind>`` behind the other flags of each row whose key others share, in the order of the kinds."""
    order = {kind: number for number, kind in enumerate(kinds)}
    number = F.lit(len(order))
    for kind, at in order.items():
        number = F.when(F.col("kind") == kind, at).otherwise(number)
    more = duplicate_members(df, kinds, member).groupBy("member").agg(F.array_sort(F.collect_set(F.struct(number.alias("at"), F.concat(F.lit("duplicate_"), "kind").alias("flag"))))["flag"].alias("__more"))
    out = df.join(more, df[member].eqNullSafe(F.col("member")), "left")
    return out.withColumn(flags, F.concat(F.col(flags), F.coalesce("__more", F.array().cast("array<string>")))).drop("member", "__more")


def insert_or_ignore(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """``stored`` and those rows of ``incoming`` whose key is new, the first of each key."""
    new = first_wins(incoming, keys, seq).join(stored.select(*keys), list(keys), "left_anti")
    return stored.unionByName(new.select(*stored.columns))


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return wanted.join(done.select(key).distinct(), key, "left_anti")
