"""Ordered change events reduced, compared and applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def net_changes(batch: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """The last event of each key: op (I, U or D), lsn and the columns; a moved key's old value is a delete of it.

    Where the batch has ``unchanged``, the names of columns an update didn't
    send, a column's value is that of the key's last event that sent it, and
    ``unchanged`` keeps the names that no event of the batch sent.
    """
    partial = ["unchanged"] if "unchanged" in batch.columns else []
    kept = ["op", "lsn", *columns, *partial]
    events = batch.where("op <> 'T'")
    moved = None
    if all(f"old_{k}" in batch.columns for k in key):
        moved = events.where(" OR ".join(f"(old_{k} IS NOT NULL AND old_{k} <> {k})" for k in key))
        former = [F.coalesce(f"old_{c}", c).alias(c) if c in key else F.col(c) for c in columns]
        moved = moved.select(F.lit("D").alias("op"), "lsn", *former, *[F.array().cast("array<string>").alias(p) for p in partial])
    events = events.select(*kept)
    events = events if moved is None else events.unionByName(moved)
    at = F.struct("lsn", (F.col("op") != "D").cast("int"))
    last = F.max_by(F.struct(*kept), at)
    found = [last.alias("e")]
    if partial:
        sent = lambda c: F.coalesce(~F.array_contains("unchanged", c), F.lit(True))
        found += [F.max_by(F.when(sent(c), F.struct(F.col(c).alias("v"))), F.when(sent(c), at)).alias(f"_{c}_sent") for c in columns if c not in key]
    net = events.groupBy(*[F.col(k).alias(f"_{k}_key") for k in key]).agg(*found)
    if not partial:
        return net.select("e.*")
    rest = [c for c in columns if c not in key]
    missing = F.array_compact(F.array(*[F.when(F.col(f"_{c}_sent").isNull(), F.lit(c)) for c in rest], F.lit(None).cast("string")))
    return net.select("e.op", "e.lsn", *[F.col(f"e.{c}") if c in key else F.col(f"_{c}_sent.v").alias(c) for c in columns], missing.alias("unchanged"))


def completed(net: DataFrame, base: DataFrame, key: list[str]) -> DataFrame:
    """Net changes whose unsent values are the base row's."""
    rest = [c for c in base.columns if c not in key]
    old = base.select(*key, F.struct(*rest).alias("_old")) if rest else None
    if old is None:
        return net.drop("unchanged")
    joined = net.join(old, key, "left")
    value = lambda c: F.when(F.array_contains("unchanged", c), F.col(f"_old.{c}")).otherwise(F.col(c)).alias(c)
    return joined.select("op", "lsn", *[F.col(c) if c in key else value(c) for c in base.columns])


def upsert(rows: DataFrame, net: DataFrame, key: list[str], admitted: Column | None = None) -> DataFrame:
    """Rows without the changed keys, and the changed rows that are admitted."""
    fresh = net.where("op <> 'D'").select(*rows.columns)
    return rows.join(net.select(*key), key, "left_anti").select(*rows.columns).unionByName(fresh if admitted is None else fresh.where(admitted))


def changed_columns(before: DataFrame, net: DataFrame, key: list[str]) -> DataFrame:
    """Changed keys that are held, with the names of the columns whose values differ, nulls being alike."""
    rest = [c for c in before.columns if c not in key]
    old = before.select(*key, F.struct(*rest, F.lit(0).alias("_")).alias("_old"))
    differs = [F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in rest]
    return net.join(old, key).withColumn("changed", F.array_compact(F.array(*differs, F.lit(None).cast("string"))))


def without_key(rows: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of a table without a key after inserts and deletes of whole rows; each delete takes one equal row."""
    columns = rows.columns
    return rows.unionByName(batch.where("op = 'I'").select(*columns)).exceptAll(batch.where("op = 'D'").select(*columns))
