"""Tables that several jobs of one query read, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from arborlake.sources.single import remove

_made: list[str] = []


def fresh(spark: SparkSession) -> str:
    """The name of a new folder below ``spark.checkpoint.dir``; on one machine, where that is unset, below its own temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    _made.append(f"{base.rstrip('/')}/arborlake-{uuid.uuid4().hex}")
    return _made[-1]


def kept(df: DataFrame) -> DataFrame:
    """``df`` written and read back, so that what follows does not run it again, nor differently."""
    folder = fresh(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def clear(spark: SparkSession) -> None:
    """Deletes the folders made so far; results that read them are lost."""
    while _made:
        remove(spark, _made.pop())
