"""Content hashes, duplicates, replicas and the largest files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.operators.ordered import PART, ROW, running

CHUNK = 1 << 20


def content_hash(content: Column, algorithm: str = "sha256") -> Column:
    """Lower-case hex by a built-in function."""
    known = {"sha224": lambda c: F.sha2(c, 224), "sha256": lambda c: F.sha2(c, 256), "sha384": lambda c: F.sha2(c, 384), "sha512": lambda c: F.sha2(c, 512), "sha1": F.sha1, "md5": F.md5}
    if algorithm not in known:
        raise ValueError(f"no built-in function for {algorithm}; use hash_files")
    return known[algorithm](content.cast("binary"))


def hash_files(files: DataFrame, algorithm: str = "sha256", path_col: str = "full_path") -> DataFrame:
    """(file_path, hash, algorithm) of the files that can be read, in chunks; any algorithm of hashlib."""
    hashlib.new(algorithm)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, digests = [], []
            for path in batch.column(0).to_pylist():
                try:
                    with open(path, "rb") as f:
                        h = hashlib.new(algorithm)
                        while chunk := f.read(CHUNK):
                            h.update(chunk)
                except OSError:
                    continue
                paths.append(path)
                digests.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(digests, pa.string()), pa.array([algorithm] * len(paths), pa.string())], names=["file_path", "hash", "algorithm"])

    return files.where(F.col(path_col).isNotNull()).select(path_col).mapInArrow(run, "file_path string, hash string, algorithm string")


def duplicates(hashed: DataFrame) -> DataFrame:
    """Per content that occurs twice: copies, bytes of one, bytes that a single copy would save, and the first path.

    Only sums are shuffled, so one content of any number of copies costs a row a task.
    """
    out = hashed.groupBy("hash").agg(F.count("*").alias("copies"), F.max("size").alias("size"), F.sum("size").cast("long").alias("total"), F.min("full_path").alias("first_path")).where("copies > 1")
    return out.select("hash", "copies", "size", (F.col("total") - F.col("size")).alias("wasted"), "first_path")


def duplicate_members(hashed: DataFrame) -> DataFrame:
    """Every file whose content occurs twice."""
    twice = hashed.groupBy("hash").count().where("count > 1").select("hash")
    return hashed.join(twice, "hash", "left_semi")


#: A content with more than a COMMON-th of the rows is common; there are fewer than COMMON of them in any number of rows.
COMMON = 1000


def replicas(held: DataFrame, devices: DataFrame, few: bool = False) -> DataFrame:
    """Per content: on how many devices it is, and whether only on mobile ones; ``held`` has (hash, device_id), ``devices`` (device_id, device_type).

    ``few``: most contents have few rows, so that a task's counts are hardly fewer than its rows; the same result with fewer rows shuffled.
    """
    if few:
        return _replicas_of_few(held, devices)
    known = held.select("hash", "device_id").distinct().join(devices.select("device_id", "device_type"), "device_id", "left")
    return known.groupBy("hash").agg(F.count("*").alias("replicas"), F.bool_and(F.coalesce(F.col("device_type") == "mobile", F.lit(False))).alias("mobile_only"))


def _replicas_of_few(held: DataFrame, devices: DataFrame) -> DataFrame:
    """Rows meet their device first and are dealt out by hash once; sorted there, each device counts once.

    All rows of a common content would go to one task so; common ones are counted as usual. ``held`` is read at once to find them, then for the other contents, and again if there are common ones.
    """
    mobile = F.coalesce(F.col("device_type") == "mobile", F.lit(False))
    kinds = devices.groupBy("device_id").agg(F.count("*").alias("times"), F.bool_and(mobile).alias("mobile"))  # an id that comes twice counts twice
    key = F.xxhash64("hash")
    common = _common(held.select(key.alias("key")))
    by_device = Window.partitionBy("hash").orderBy("device_id")
    first = F.row_number().over(by_device) == F.rank().over(by_device)  # of equal rows
    rest = held.where(~key.isin(common)) if common else held
    known = rest.select("hash", "device_id").join(kinds, "device_id", "left").withColumn("first", first).where("first")
    out = known.groupBy("hash").agg(F.sum(F.coalesce("times", F.lit(1))).alias("replicas"), F.bool_and(F.coalesce("mobile", F.lit(False))).alias("mobile_only"))
    return out.unionByName(replicas(held.where(key.isin(common)), devices)) if common else out


def _common(keyed: DataFrame) -> list[int]:
    """Keys of the common contents, by a sketch of fixed size over all rows. It only decides how a content is dealt out, not what is counted."""
    n, top = keyed.agg(F.count("*"), F.expr(f"approx_top_k(key, {COMMON})")).first()
    return [x["item"] for x in top or [] if x["count"] * COMMON > n]


def at_risk(held: DataFrame, devices: DataFrame) -> DataFrame:
    """Contents on a single device, or on mobile ones only."""
    return replicas(held, devices, few=True).where("replicas = 1 OR mobile_only")


#: Rows up to which a page is the end of a sort that keeps no more than so many per task.
TOP_ROWS = 10_000


class Ranking:
    """The files by falling size, ties by path, sorted by range once; a page reads the one or two ranges that hold it."""

    def __init__(self, files: DataFrame) -> None:
        self.table = running(files, [], [F.desc("size"), F.asc("full_path")])
        self.columns = files.columns
        self.counts = [(r[0], r[1]) for r in self.table.groupBy(PART).count().orderBy(PART).collect()]  # one row a range

    def page(self, page: int = 0, per_page: int = 20) -> DataFrame:
        first, wanted, at = page * per_page, F.lit(False), 0
        for part, n in self.counts:
            low, high = max(first - at, 0), min(first + per_page - at, n)
            if low < high:
                wanted = wanted | ((F.col(PART) == part) & (F.col(ROW) >= low) & (F.col(ROW) < high))
            at += n
        return self.table.where(wanted).orderBy(PART, ROW).select(*self.columns)


def largest(files: DataFrame, page: int = 0, per_page: int = 20) -> DataFrame:
    """A page of the files by falling size, ties by path. Early pages keep a page's rows per task; for later ones all are ranked by range."""
    if (page + 1) * per_page > TOP_ROWS:
        return Ranking(files).page(page, per_page)
    ordered = files.orderBy(F.desc("size"), "full_path")
    return ordered.offset(page * per_page).limit(per_page) if page else ordered.limit(per_page)
