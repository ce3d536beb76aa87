"""Case-insensitive name search over the entries of any number of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(name: Column, query: str) -> Column:
    """``starts:x``, ``ends:x`` or plain x; the term is literal, with no wildcards, and an empty one matches all."""
    query = query.lower()
    if query.startswith("starts:"):
        return F.startswith(F.lower(name), F.lit(query.removeprefix("starts:")))
    if query.startswith("ends:"):
        return F.endswith(F.lower(name), F.lit(query.removeprefix("ends:")))
    return F.contains(F.lower(name), F.lit(query))


def search(entries: DataFrame, query: str, snapshots: list[str] | None = None) -> DataFrame:
    """Files and directories by name: type, name, path, full_path, size, snapshot and times; sizes and times of directories are null."""
    rows = entries if snapshots is None else entries.where(F.col("snapshot").isin(list(snapshots)))
    file = F.col("kind") == "f"
    hits = rows.where(matches(F.col("name"), query))
    return hits.select(F.when(file, "file").otherwise("directory").alias("type"), "name", F.col("parent").alias("path"), "full_path", F.when(file, F.coalesce("size", F.lit(0))).cast("long").alias("size"), "snapshot", *[F.when(file, F.col(c)).alias(c) for c in ("created", "modified", "accessed")])


def in_order(hits: DataFrame, by: str = "path", descending: bool = False) -> DataFrame:
    """Hits or files by a column, nulls last; ties by snapshot, full path and name."""
    if by not in hits.columns:
        raise ValueError(f"no column {by} to sort by")
    first = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
    return hits.orderBy(first, *[c for c in ("snapshot", "full_path", "name") if c in hits.columns and c != by])


def missing_snapshots(requested: DataFrame, known: DataFrame) -> DataFrame:
    """Requested snapshots that are not there."""
    return requested.join(known.select("snapshot").distinct(), "snapshot", "left_anti")
