"""Equi-joins with the checks the preparation steps rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_parent(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Inner join on a key that must be unique among parents, so the row count is the child's."""
    twice = parent.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if twice.limit(1).count():
        raise ValueError(f"parent key {key} is not unique")
    return child.join(parent, key)


def orphans(child: DataFrame, parent: DataFrame, key) -> DataFrame:
    """Child rows whose key has no parent; must be empty for a sound pair of tables."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


def check_references(child: DataFrame, parent: DataFrame, key) -> None:
    if orphans(child, parent, key).limit(1).count():
        raise ValueError(f"some {key} of the child table are missing from the parent table")


def lookup(df: DataFrame, table: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """Attach a keyed table; with ``strict`` a key without an entry is an error."""
    if strict and df.join(table.select(*keys).distinct(), keys, "left_anti").limit(1).count():
        raise ValueError(f"some keys {keys} have no entry in the lookup table")
    return df.join(table, keys)


def complement(df: DataFrame, sample: DataFrame, key) -> DataFrame:
    """Rows that are not in the sample."""
    return df.join(sample.select(key), key, "left_anti")
