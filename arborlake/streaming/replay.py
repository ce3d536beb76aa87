"""The group log as a stream: the state store has each member's last action, and a batch writes those of the members it names.

A batch costs its own lines, not the whole state: a batch is grouped like a whole log, and each member of it meets its state once.
Lines count by their place in the log, so late and repeated lines change nothing. Changes go into a folder per batch, which a batch that runs again replaces, and are folded into one table
from time to time; the record of the last batch says which folders have to be there.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arborlake.sources.single import exists, remove

STATE = "snapshot string, group string, kind string, path string, action string, seq bigint"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Batches after which their changes are folded into one table.
FOLD = 50


def last_actions(log: DataFrame) -> DataFrame:
    """The last action of each member by line order."""
    known = log.where(F.col("action").isin("add", "del"))
    return known.groupBy("snapshot", "group", "kind", "path").agg(F.max_by("action", "seq").alias("action"), F.max("seq").alias("seq"))


def _at(folder: str, batch: int) -> str:
    return f"{folder}/changes/batch={batch}"


def _recorded(spark: SparkSession, folder: str) -> dict:
    """{"last": last batch written, "folded": the batch up to which changes are in one table}, -1 before the first; of the newest record."""
    if not exists(spark, f"{folder}/record"):
        return {"last": -1, "folded": -1}
    rows = spark.read.text(f"{folder}/record/*").collect()  # FOLD lines at most
    return max((json.loads(r.value) for r in rows), key=lambda r: r["last"], default={"last": -1, "folded": -1})


def _record(spark: SparkSession, folder: str, record: dict) -> None:
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/record/at={record['last']}")


def start(log: DataFrame, folder: str, checkpoint: str, fold: int = FOLD) -> StreamingQuery:
    """Keeps the changes in ``folder`` and returns the query; ``log`` is the stream (snapshot, seq, path, kind, group, action)."""
    spark = log.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    changed = last_actions(log.withColumn("seq", F.col("seq").cast("long")))

    def write(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        batch.write.mode("overwrite").parquet(_at(folder, number))
        record = _recorded(s, folder)
        if record["last"] >= number:  # the batch ran before and was recorded
            return
        record["last"] = number
        if number - record["folded"] >= fold:
            last_actions(_changes(s, folder, record)).write.mode("overwrite").parquet(f"{folder}/folded={number}")
            old, record["folded"] = record["folded"], number
            _record(s, folder, record)
            for b in range(old + 1, number):
                remove(s, _at(folder, b))
                remove(s, f"{folder}/record/at={b}")
            remove(s, f"{folder}/folded={old}")
            remove(s, f"{folder}/record/at={old}")
        else:
            _record(s, folder, record)

    return changed.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).start()


def _changes(spark: SparkSession, folder: str, record: dict) -> DataFrame:
    parts = ([f"{folder}/folded={record['folded']}"] if record["folded"] >= 0 else []) + [_at(folder, b) for b in range(record["folded"] + 1, record["last"] + 1)]
    missing = [p for p in parts if not exists(spark, p)]
    if missing:
        raise FileNotFoundError("the state is not whole: " + ", ".join(missing))
    return spark.read.schema(STATE).parquet(*parts)


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The members after the last recorded batch."""
    record = _recorded(spark, folder)
    if record["last"] < 0:
        return spark.createDataFrame([], STATE).select("snapshot", "group", "kind", "path")
    return last_actions(_changes(spark, folder, record)).where("action = 'add'").select("snapshot", "group", "kind", "path")
