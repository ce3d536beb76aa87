"""Single files, for formats that other programs read by name, on any file system that Spark can write."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

COPY_BYTES = 1 << 22


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _at(spark, path)
    return store.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at, store = _at(spark, path)
    store.delete(at, True)


def folders(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, bytes, modification time in seconds) of the folders right below ``path``."""
    at, store = _at(spark, path)
    found = [s for s in store.listStatus(at) if s.isDirectory()] if store.exists(at) else []
    return [(s.getPath().getName(), store.getContentSummary(s.getPath()).getLength(), s.getModificationTime() // 1000) for s in found]


def write_lines(lines: DataFrame, path: str, compression: str = "none") -> None:
    """The rows of ``value`` in their order as one text file; it appears under its name when it is whole, in place of an older one.

    Each task sorts and packs its own part; then only the packed bytes are strung together, as gzip files and texts may be.
    """
    spark, parts = lines.sparkSession, f"{path}.{uuid.uuid4().hex}"
    lines.select("value").write.option("compression", compression).text(parts)
    at, store = _at(spark, parts)
    target = _at(spark, path)[0]
    written = sorted((s.getPath() for s in store.listStatus(at) if s.getPath().getName().startswith("part-")), key=lambda p: [int(n) for n in re.match(r"part-(\d+)-.*?-c(\d+)", p.getName()).groups()])
    whole = written[0]
    if len(written) > 1:
        whole, copy = _at(spark, f"{parts}/whole")[0], spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes
        out = store.create(whole)
        try:
            for p in written:
                part = store.open(p)
                try:
                    copy(part, out, COPY_BYTES)
                finally:
                    part.close()
        finally:
            out.close()
    store.delete(target, False)
    if not store.rename(whole, target):
        raise OSError(f"{path} could not be written")
    store.delete(at, True)
