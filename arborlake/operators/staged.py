"""Duplicates of files found in stages, so that only files that still agree are read further.

Files of a size of their own are never opened. Of the others the first and last block is read; what agrees there is cut into
ranges of bytes that different tasks read, and a file's digest is that of its ranges' digests in order. So one file
of any size is spread over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.sources.scratch import kept

#: Bytes of a block at either end, and of a range that one task reads.
ENDS, RANGE = 1 << 16, 64 << 20
#: Bytes read at a time.
STEP = 1 << 20


def _open(path: str):
    store, at = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    return store.open_input_file(at)


def _digest(path: str, ranges: list[tuple[int, int]]) -> bytes | None:
    """SHA-256 of the given (begin, bytes) of a file; none if it cannot be read or has become shorter."""
    h = hashlib.sha256()
    try:
        with _open(path) as f:
            for begin, size in ranges:
                while size > 0:
                    data = f.read_at(min(size, STEP), begin)
                    if not data:
                        return None
                    h.update(data)
                    begin, size = begin + len(data), size - len(data)
    except (OSError, pa.ArrowException):
        return None
    return h.digest()


def _digests(parts: DataFrame) -> DataFrame:
    """``parts`` (path, ..., ranges) with their digest; parts that cannot be read drop out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                s = b.slice(a, 256)
                found = [_digest(p, [(r["begin"], r["size"]) for r in ranges]) for p, ranges in zip(s.column("full_path").to_pylist(), s.column("ranges").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*s.columns, pa.array(found, pa.binary())], names=[*s.schema.names, "digest"])

    return parts.mapInArrow(run, parts.select("*", F.lit(None).cast("binary").alias("digest")).schema).where("digest IS NOT NULL")


def _range(begin, size):
    return F.struct(begin.cast("long").alias("begin"), size.cast("long").alias("size"))


def _twice(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(rows.groupBy(*keys).count().where("count > 1").drop("count"), keys, "left_semi")


def alike(files: DataFrame, ends: int = ENDS, most: int = RANGE) -> DataFrame:
    """(full_path, size, digest, bytes_read) of all ``files`` (full_path, size): equal digests where contents are equal, null where
    no other file has the content or it cannot be read. Repeated rows of one path are one file.
    """
    known = files.where("full_path IS NOT NULL").select("full_path", F.coalesce("size", F.lit(0)).cast("long").alias("size")).groupBy("full_path").agg(F.max("size").alias("size"))
    known = kept(known)
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = F.when(F.col("size") <= 2 * ends, F.array(_range(F.lit(0), F.col("size")))).otherwise(F.array(_range(F.lit(0), F.lit(ends)), _range(F.col("size") - ends, F.lit(ends))))
    at_ends = kept(_digests(_twice(known, ["size"]).withColumn("ranges", both).repartition(n, "full_path")).select("full_path", "size", "digest"))
    agree = kept(_twice(at_ends, ["size", "digest"]))
    # Short files are read whole by now.
    short = agree.where(F.col("size") <= 2 * ends).select("full_path", "size", F.lower(F.hex("digest")).alias("digest"))
    rest = agree.where(F.col("size") > 2 * ends).select("full_path", "size")
    begins = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(most).cast("long"))
    cut = rest.select("full_path", "size", F.explode(begins).alias("begin")).withColumn("ranges", F.array(_range(F.col("begin"), F.least(F.lit(most), F.col("size") - F.col("begin")))))
    read = _digests(cut.repartition(n, "full_path", "begin")).select("full_path", "size", "begin", "digest")
    whole = read.groupBy("full_path", "size").agg(F.array_sort(F.collect_list(F.struct("begin", "digest"))).alias("x"))
    whole = whole.where(F.size("x") == F.ceil(F.col("size") / most)).select("full_path", "size", F.sha2(F.array_join(F.transform("x.digest", lambda d: F.hex(d)), ""), 256).alias("digest"))
    same = kept(short.unionByName(whole))
    final = _twice(same, ["size", "digest"]).select("full_path", F.concat_ws(":", "size", "digest").alias("digest"))
    opened = at_ends.select("full_path", F.least(F.col("size"), F.lit(2 * ends)).alias("first_bytes"))
    further = rest.select("full_path", F.col("size").alias("more_bytes"))
    out = known.join(final, "full_path", "left").join(opened, "full_path", "left").join(further, "full_path", "left")
    return out.select("full_path", "size", "digest", (F.coalesce("first_bytes", F.lit(0)) + F.coalesce("more_bytes", F.lit(0))).cast("long").alias("bytes_read"))


def duplicate_groups(found: DataFrame) -> DataFrame:
    """Of ``alike``'s rows, per content that occurs twice: digest, copies, size, wasted bytes and the first path."""
    out = found.where("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("copies"), F.max("size").alias("size"), F.min("full_path").alias("first_path"))
    return out.select("digest", "copies", "size", (F.col("size") * (F.col("copies") - 1)).alias("wasted"), "first_path")
