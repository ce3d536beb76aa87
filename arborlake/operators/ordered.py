"""Ranks, running sums and running maxima in a given order, without a task that holds a whole key.

Rows are range-partitioned by key and order, so a key of any size is spread over many tasks. Each task adds up what it
has; what the tasks before it had of its first key is added afterwards. Between the two steps the rows stand in a table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.sources.scratch import kept

PART, ROW, OPEN = "__part", "__row", "__open"


def new_runs(columns: list[pa.Array], before: tuple | None) -> np.ndarray:
    """True where a row's values differ from those of the row above it; ``before`` is the row above the first."""
    n = len(columns[0])
    out = np.zeros(n, dtype=bool)
    for c in columns:
        differ = pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
        gone = c.is_null().to_numpy(zero_copy_only=False)
        out[1:] |= differ | (gone[1:] != gone[:-1])
    out[0] = before is None or tuple(c[0].as_py() for c in columns) != before
    return out


def _running(values: np.ndarray, start: np.ndarray, carried: int, first: bool, highest: bool) -> np.ndarray:
    """Sums or maxima from each start on; the first rows go on from ``carried`` unless they are a start (``first``)."""
    n = len(values)
    if highest:
        # Maxima by run: runs are lifted apart, so that one pass over all serves each of them.
        low, high = int(values.min()), int(values.max())
        run = np.cumsum(start) if n else start
        if (high - low + 1) * (int(run[-1]) + 1) < 1 << 62:
            lift = run * (high - low + 1)
            out = np.maximum.accumulate(values - low + lift) - lift + low
        else:
            cuts = [*np.flatnonzero(start).tolist(), n]
            cuts = cuts if cuts[0] == 0 else [0, *cuts]
            out = np.concatenate([np.maximum.accumulate(values[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])
        lead = 0 if first else (int(np.argmax(start)) if start.any() else n)
        out[:lead] = np.maximum(out[:lead], carried)
        return out
    total = np.cumsum(values)
    at = np.maximum.accumulate(np.where(start, np.arange(n), -1))
    return np.where(at >= 0, total - np.where(at > 0, total[np.maximum(at, 1) - 1], 0), total + carried)


def running(rows: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, str] | None = None, highs: dict[str, str] | None = None, rank: str | None = None) -> DataFrame:
    """``rows`` with, by key and in order: ``rank`` from 0 on, running ``sums`` and ``highs`` (new name: column), own row included.

    The columns summed must be whole numbers without nulls. Also returned: the partition and the row's place in it
    (PART, ROW). One row a partition passes through the driver.
    """
    spark, sums, highs = rows.sparkSession, sums or {}, highs or {}
    columns, names = rows.columns, [*([rank] if rank else []), *sums, *highs]
    key_at, at = [columns.index(k) for k in keys], {**{n: columns.index(c) for n, c in sums.items()}, **{n: columns.index(c) for n, c in highs.items()}}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, before, carried, is_open = TaskContext.get().partitionId(), 0, None, dict.fromkeys(names, 0), True
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            start = new_runs([b.column(i) for i in key_at], before) if keys else np.arange(row, row + n) == 0
            made = {}
            for name in names:
                values = np.ones(n, dtype=np.int64) if name == rank else b.column(at[name]).to_numpy(zero_copy_only=False).astype(np.int64)
                made[name] = _running(values, start, carried[name], bool(start[0]), name in highs)
            in_first = np.cumsum(start) == (1 if row == 0 else 0) if is_open else np.zeros(n, dtype=bool)
            before = tuple(b.column(i)[n - 1].as_py() for i in key_at)
            carried, is_open = {k: int(v[-1]) for k, v in made.items()}, bool(in_first[-1])
            more = [pa.array(made[k] - (k == rank), pa.int64()) for k in names]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(row, row + n), pa.int64()), pa.array(in_first, pa.bool_()), *more], names=[*b.schema.names, PART, ROW, OPEN, *names])
            row += n

    schema = rows.select("*", F.lit(0).alias(PART), F.lit(0).cast("long").alias(ROW), F.lit(True).alias(OPEN), *[F.lit(0).cast("long").alias(n) for n in names]).schema
    by = [*keys, *order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by) if by else rows.coalesce(1)
    table = kept(dealt.mapInArrow(run, schema))
    key = F.struct(F.lit(0).alias("__any"), *keys)
    ends = table.groupBy(PART).agg(F.min_by(key, ROW).alias("first"), F.max_by(key, ROW).alias("last"), F.max_by(F.struct(OPEN, *names), ROW).alias("end")).orderBy(PART).collect()
    added, total, last = [], None, None
    for e in ends:  # one a partition
        carry = total if last is not None and tuple(e.first) == last else None
        if carry and (highs or any(carry)):
            added.append((e[PART], *carry))
        done = [e.end[n] + (1 if n == rank else 0) for n in names]
        if carry and e.end[OPEN]:
            done = [max(a, c) if n in highs else a + c for n, a, c in zip(names, done, carry, strict=True)]
        total, last = done, tuple(e.last)
    if not added or not names:
        return table.drop(OPEN)
    offsets = spark.createDataFrame(added, ", ".join([f"{PART} int", *[f"`__add_{n}` bigint" for n in names]]))
    met = table.join(F.broadcast(offsets), PART, "left")
    more = lambda n: F.when(F.col(OPEN) & F.col(f"__add_{n}").isNotNull(), F.greatest(n, f"__add_{n}") if n in highs else F.col(n) + F.col(f"__add_{n}")).otherwise(F.col(n))
    return met.select(*columns, PART, ROW, *[more(n).alias(n) for n in names])


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of one ``key`` after another, from batches sorted by it; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cuts = np.flatnonzero(new_runs([b.column(key)], last)).tolist()
        for a, z in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            if a in cuts and held:
                yield pa.Table.from_batches(held)
                held = []
            if z > a:
                held.append(b.slice(a, z - a))
        last = (b.column(key)[b.num_rows - 1].as_py(),)
    if held:
        yield pa.Table.from_batches(held)
