"""Upserts, deletions and eviction as joins and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, same: str) -> DataFrame:
    """Rows of both; where a key is in both, the old row stays if ``same`` is equal, else the new one replaces it."""
    o, n = old.select(F.struct(*old.columns).alias("o")), new.select(F.struct(*old.columns).alias("n"))
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    row = F.when(F.col("n").isNull() | F.col(f"o.{same}").eqNullSafe(F.col(f"n.{same}")) & F.col("o").isNotNull(), F.col("o")).otherwise(F.col("n"))
    return both.select(row.alias("r")).select("r.*")


def delete_missing(old: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return old.join(seen.select(key).distinct(), key, "left_semi")


def missing(old: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return old.select(key).join(seen.select(key).distinct(), key, "left_anti")


def evict(rows: DataFrame, keep: int, newest: str, key: str) -> DataFrame:
    """The ``keep`` newest rows."""
    return rows.orderBy(F.desc(newest), F.desc(key)).limit(keep)
