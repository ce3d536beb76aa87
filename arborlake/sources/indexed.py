"""Indexed snapshots: parts of gzip JSON Lines with one member per directory, and an index of where each member stands.

A snapshot is a folder, read whole by anything that reads gzip files of lines. With the index a directory costs the bytes
of its own member, and the whole is read in parallel by byte ranges, as members can be cut anywhere between.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.sources.snapshots import META, parsed, to_lines

INDEX = "snapshot string, seq long, p string, file string, at long, size long"
_INDEX = [("snapshot", pa.string()), ("seq", pa.int64()), ("p", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())]
#: Below the snapshot's folder; readers of text files pass over names that begin so.
INDEX_FOLDER = "_index"
#: Bytes that one range has at most, if its first member has no more.
RANGE_BYTES = 8 << 20


def write_indexed(dirs: DataFrame, entries: DataFrame, folder: str, meta: dict | None = None) -> DataFrame:
    """Writes the directories in order of their numbers, each task a part of its own, and returns the index, which is sorted by path."""
    lines = to_lines(dirs, entries).join(dirs.select("snapshot", "seq", F.col("path").alias("p")), ["snapshot", "seq"])
    more = ", " + json.dumps({k: meta[k] for k in META if meta.get(k) is not None})[1:] if meta else "}"

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name = None, 0, f"part-{uuid.uuid4().hex}.jsonl.gz"
        try:
            for b in batches:
                if out is None:
                    store, path = fs.FileSystem.from_uri(folder)
                    store.create_dir(path)
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                offsets, sizes = [], []
                for seq, value in zip(b.column("seq").to_pylist(), b.column("value").to_pylist(), strict=True):
                    line = value[:-1] + more if seq == 0 else value
                    member = gzip.compress(line.encode() + b"\n", 6, mtime=0)
                    out.write(member)
                    offsets.append(at)
                    sizes.append(len(member))
                    at += len(member)
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column("snapshot"), b.column("seq"), b.column("p"), pa.array([name] * n, pa.string()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())], names=[k for k, _ in _INDEX])
        finally:
            if out is not None:
                out.close()

    dealt = lines.select("snapshot", "seq", "p", "value").repartitionByRange("snapshot", "seq").sortWithinPartitions("snapshot", "seq")
    spark, raw = dirs.sparkSession, f"{folder}/_written"
    dealt.mapInArrow(write, INDEX).write.mode("overwrite").parquet(raw)  # the members are written once, whatever reads the index
    spark.read.schema(INDEX).parquet(raw).repartitionByRange("p").sortWithinPartitions("p").write.option("parquet.block.size", str(1 << 20)).mode("overwrite").parquet(f"{folder}/{INDEX_FOLDER}")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index; a filter on ``p`` reaches its Parquet files, which are sorted by it."""
    return spark.read.schema(INDEX).parquet(f"{folder}/{INDEX_FOLDER}")


def ranges(places: list[tuple[str, int, int]], most: int = RANGE_BYTES) -> list[tuple[str, int, int, int]]:
    """(file, begin, bytes, members) of sorted members, those that follow each other in one range of ``most`` bytes."""
    out: list[list] = []
    for file, at, size in places:
        last = out[-1] if out else None
        if last and last[0] == file and last[1] + last[2] == at and last[2] + size <= most:
            last[2], last[3] = last[2] + size, last[3] + 1
        else:
            out.append([file, at, size, 1])
    return [tuple(r) for r in out]


def read_members(index: DataFrame, folder: str) -> DataFrame:
    """(snapshot, seq, value) of the given rows of the index, read by ranges that hold no other bytes; any rows, in as many tasks as shuffles have."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for b in batches:
            places = list(zip(*(b.column(c).to_pylist() for c in ("file", "at", "size")), strict=True))
            names, row = list(zip(b.column("snapshot").to_pylist(), b.column("seq").to_pylist(), strict=True)), 0
            for file, begin, size, members in ranges(places):
                with store.open_input_file(f"{path}/{file}") as f:
                    data = f.read_at(size, begin)
                here = range(row, row + members)
                text = [gzip.decompress(data[places[i][1] - begin : places[i][1] - begin + places[i][2]]).decode().rstrip("\n") for i in here]
                yield pa.RecordBatch.from_arrays([pa.array([names[i][0] for i in here], pa.string()), pa.array([names[i][1] for i in here], pa.int64()), pa.array(text, pa.string())], names=["snapshot", "seq", "value"])
                row += members

    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.select("snapshot", "seq", "file", "at", "size").repartitionByRange(n, "file", "at").sortWithinPartitions("file", "at")
    return dealt.mapInArrow(read, "snapshot string, seq long, value string")


def read_indexed(spark: SparkSession, folder: str, paths: DataFrame | None = None) -> DataFrame:
    """The lines of an indexed snapshot as ``snapshots.read_lines`` gives them: all, or those of the directories in ``paths`` (p)."""
    index = read_index(spark, folder)
    if paths is not None:
        index = index.join(paths.select("p").distinct(), "p", "left_semi")
    return parsed(read_members(index, folder))
