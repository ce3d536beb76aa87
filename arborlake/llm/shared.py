"""Where operators put what several tasks or jobs have to see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    The cluster names that folder; only on one machine, where it is unset, a temporary one
    is made and set. Folders stay until ``clear``, as results are read from them.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    _made.append(f"{base.rstrip('/')}/arborlake-{uuid.uuid4().hex}")
    return _made[-1]


def clear(spark: SparkSession) -> None:
    """Deletes the folders that this driver has made; results that read them are lost."""
    while _made:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, into: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` written to the shared folder, with the writer's ``options``, and read back.

    This cuts the lineage: what reads the result survives lost executors without
    running the plan above it again.
    """
    path = into or shared_dir(df.sparkSession)
    df.write.mode("overwrite").options(**options or {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_parts(df: DataFrame) -> int:
    """The session's number of shuffle partitions, for small index rows that stand for large reads:
    given as a number, Spark does not coalesce them by the size of the index.
    """
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Of rows of hundreds of KB: the writer looks at the size of pages (1 MB) and row groups after each row, not after each hundred; counts and codes shrink by a fifth more than by the default codec.
WIDE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false", "compression": "zstd", "parquet.compression.codec.zstd.level": "1"}


@contextmanager
def batches_of(spark: SparkSession, most: int) -> Iterator[None]:
    """What runs meanwhile hands Python batches of ``most`` bytes and a row at most, whatever the session's limit, which comes back after."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def rows_as(batch_columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(batch_columns[f.name], f.type) for f in schema], schema=schema)


def sorted_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Groups of equal ``key`` from batches sorted by it; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_pylist()
        start = 0
        for i, k in enumerate(keys):
            if (held or i) and k != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield last, pa.Table.from_batches(held)
                held, start = [], i
            last = k
        held.append(batch.slice(start))
    if held:
        yield last, pa.Table.from_batches(held)
