"""Layered merges, upserts and change history, as full rewrites of a keyed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from offerloom.functions.text import is_set
from offerloom.operators.ranking import last_wins, latest_per_key


def set_or_null(c: Column) -> Column:
    return F.when(c.isNotNull() & (c.cast("string") != ""), c)


def _policy(policy: dict[str, str], column: str, base: Column, richer: Column) -> Column:
    kind = policy.get(column, policy.get("*", "override"))
    if kind == "pin":
        return base
    if kind == "fill":
        return F.coalesce(set_or_null(base), set_or_null(richer))
    return F.coalesce(set_or_null(richer), base)


def layer(base: DataFrame, richer: DataFrame, key: str, policy: dict[str, str] | None = None, how: str = "left") -> DataFrame:
    """``base`` with values of ``richer`` by key; ``status`` says what a row is: base, enriched or added.

    A column's policy is override (the set value of ``richer`` wins), fill (only where ``base`` has none) or pin; "*" is the rest.
    With ``how`` full_outer the rows of ``richer`` alone are added. Keys are unique on both sides, see first and last wins.
    """
    policy = policy or {}
    b, r = base.alias("b"), richer.alias("r")
    joined = b.join(r, F.col(f"b.{key}") == F.col(f"r.{key}"), how)
    out = [F.coalesce(F.col(f"b.{key}"), F.col(f"r.{key}")).alias(key)]
    for c in base.columns:
        if c == key:
            continue
        left = F.col(f"b.{c}")
        value = _policy(policy, c, left, F.col(f"r.{c}")) if c in richer.columns else left
        if c in richer.columns and how == "full_outer":
            value = F.when(F.col(f"b.{key}").isNull(), F.col(f"r.{c}")).otherwise(value)
        out.append(value.alias(c))
    status = F.when(F.col(f"b.{key}").isNull(), "added").when(F.col(f"r.{key}").isNull(), "base").otherwise("enriched")
    return joined.select(*out, status.alias("status"))


def layer_with_fallback(base: DataFrame, richer: DataFrame, first_key: str, second_key: str, policy: dict[str, str]) -> DataFrame:
    """As ``layer``, but rows that the first key doesn't find are looked up by the second."""
    hit = base.join(richer.select(first_key), first_key, "left_semi")
    miss = base.join(richer.select(first_key), first_key, "left_anti")
    by_first = layer(hit, richer, first_key, policy | {second_key: "pin"})
    by_second = layer(miss, richer, second_key, policy | {first_key: "pin"})
    return by_first.unionByName(by_second.select(*by_first.columns))


def tiered_lookup(rows: DataFrame, stored: DataFrame, tiers: Sequence[Sequence[str]], id_column: str, row_id: str) -> DataFrame:
    """``rows`` with ``found_id`` and ``found_tier``: the smallest stored id of the first tier of keys that finds one.

    Tiers with an unset first column are passed over.
    """
    out, found = rows, []
    for number, tier in enumerate(tiers, 1):
        ids = stored.filter(is_set(tier[0])).groupBy(*tier).agg(F.min(id_column).alias(f"__id{number}"))
        ids = ids.select(*[F.col(c).alias(f"__{number}_{c}") for c in tier], f"__id{number}")
        same = [F.col(f"__{number}_{c}").eqNullSafe(F.col(c)) for c in tier]
        condition = same[0]
        for s in same[1:]:
            condition = condition & s
        out = out.join(ids, condition, "left").drop(*[f"__{number}_{c}" for c in tier])
        found.append(F.col(f"__id{number}"))
    tier = F.lit(None).cast("int")
    for number in range(len(tiers), 0, -1):
        tier = F.when(found[number - 1].isNotNull(), number).otherwise(tier)
    return out.select(*rows.columns, F.coalesce(*found).alias("found_id"), tier.alias("found_tier"))


def keep_old_when_null(stored: DataFrame, batch: DataFrame, key: str, seq: str) -> DataFrame:
    """Fold the batch per key, the last set value of each column; unset columns keep the stored value."""
    columns = [c for c in stored.columns if c != key]
    order = W.partitionBy(key).orderBy(F.desc(seq))
    folded = batch
    for c in columns:
        folded = folded.withColumn(c, F.first(set_or_null(F.col(c)), ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing)))
    folded = last_wins(folded, [key], [seq])
    return layer(stored, folded.select(key, *columns), key, {"*": "override"}, "full_outer").drop("status")


def changes(observations: DataFrame, key: Sequence[str], order: Sequence[str], watched: Sequence[str]) -> DataFrame:
    """The observations that differ from the one before in a watched column; a key's first always does. Nulls equal nulls."""
    w = W.partitionBy(*key).orderBy(*order)
    same = F.lit(True)
    for c in watched:
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    marked = observations.withColumn("__new", (F.row_number().over(w) == 1) | ~same)
    return marked.filter("__new").drop("__new")


def current_state(observations: DataFrame, key: Sequence[str], time: str, tie: Sequence[str] = ()) -> DataFrame:
    """The last observation of each key with ``first_seen`` and ``last_seen``."""
    spans = observations.groupBy(*key).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"))
    return latest_per_key(observations, key, time, tie).join(spans, list(key))


def upsert(current: DataFrame, batch: DataFrame, key: str, watched: Sequence[str], seen_at: Column) -> tuple[DataFrame, DataFrame]:
    """The new current table and the history rows of a batch with unique keys.

    ``current`` has key, watched columns, first_seen_at, last_seen_at. A row is history if its key is new or a watched value differs.
    """
    c, b = current.alias("c"), batch.alias("b")
    joined = c.join(b, F.col(f"c.{key}") == F.col(f"b.{key}"), "full_outer")
    seen, old = F.col(f"b.{key}").isNotNull(), F.col(f"c.{key}").isNotNull()
    pick = lambda x: F.when(seen, F.col(f"b.{x}")).otherwise(F.col(f"c.{x}")).alias(x)
    state = joined.select(F.coalesce(f"b.{key}", f"c.{key}").alias(key), *map(pick, watched), F.coalesce("c.first_seen_at", seen_at).alias("first_seen_at"), F.when(seen, seen_at).otherwise(F.col("c.last_seen_at")).alias("last_seen_at"))
    same = old
    for x in watched:
        same = same & F.col(f"c.{x}").eqNullSafe(F.col(f"b.{x}"))
    history = joined.filter(seen & ~same).select(F.col(f"b.{key}").alias(key), *[F.col(f"b.{x}").alias(x) for x in watched], seen_at.alias("captured_at"))
    return state, history


def add_missing_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns in order, those that are missing as nulls of their type, then the others."""
    known = [F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in wanted.items()]
    return df.select(*known, *[c for c in df.columns if c not in wanted])
