"""Snapshots, group logs, devices and media as files: readers and writers."""

from __future__ import annotations

import json
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.functions.paths import join_path
from arborlake.sources.single import exists, folders, write_lines

META = {"device_name": "string", "device_id": "string", "cpu_model": "string", "cpu_name": "string", "memory_size": "bigint", "host_name": "string", "ip_addr": "string", "mac_addr": "string", "os_name": "string", "start_scan_time": "bigint", "finish_scan_time": "bigint"}
LINE = {"p": "string", "f": "array<string>", "d": "array<string>", "t": "array<array<bigint>>", "T": "array<array<bigint>>", "s": "array<bigint>"}
NAME = r"snapshot_(\d+)_(\d+)\.jsonl\.gz$"
DEVICE = "device_name string, device_type string, device_model string, host_name string, cpu_model string, ip_addr string, mac_addr string, os_name string, os_version string, os_release string, thumbprint string, memory_size bigint, storage_space bigint, freedesktop_os_release map<string,string>"
LOG = "snapshot string, seq struct<file:string,block:bigint,line:bigint>, path string, kind string, group string, action string, ts bigint"
MEDIA = "name string, device_id string, size bigint, created bigint"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per directory line of gzip JSON Lines snapshots: snapshot, seq, the line's fields and the metadata of line 0.

    Two pairs of keys differ by case only, so fields are taken from a variant and not by a
    JSON schema. A gzip file is one partition, which keeps its line order.
    """
    filled = spark.read.text(path).select("value", "_metadata.file_name").where(F.trim("value") != "")
    text = filled.select(F.regexp_extract("file_name", r"^(.*?)\.jsonl\.gz$", 1).alias("snapshot"), F.monotonically_increasing_id().alias("id"), "value")
    first = text.groupBy("snapshot").agg(F.min("id").alias("first"))
    rows = text.join(F.broadcast(first), "snapshot")
    return parsed(rows.select("snapshot", (F.col("id") - F.col("first")).alias("seq"), "value"))


def parsed(lines: DataFrame) -> DataFrame:
    """The fields of numbered lines (snapshot, seq, value) and the metadata that line 0 has."""
    doc = F.parse_json("value")
    fields = {k if k != "T" else "dir_times": F.variant_get(doc, f"$.{k}", kind) for k, kind in LINE.items()}
    meta = {k: F.variant_get(doc, f"$.{k}", kind) for k, kind in META.items()}
    return lines.select("snapshot", "seq", *[v.alias(k) for k, v in fields.items()], *[v.alias(k) for k, v in meta.items()])


def metadata(lines: DataFrame) -> DataFrame:
    """One row per snapshot: root and metadata, from its first line."""
    return lines.where("seq = 0").select("snapshot", F.col("p").alias("root"), *META)


def dirs_of(lines: DataFrame) -> DataFrame:
    direct = F.aggregate(F.coalesce("s", F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    meta = metadata(lines).select("snapshot", "root", F.coalesce("os_name", F.lit("Linux")).alias("os_name"))
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    return lines.select("snapshot", "seq", F.col("p").alias("path"), size("f").alias("n_files"), direct.alias("direct_size"), size("d").alias("n_subdirs")).join(F.broadcast(meta), "snapshot")


def entries_of(lines: DataFrame) -> DataFrame:
    """Files and subdirectories one row each; sizes that a ragged line lacks are 0, times null."""
    meta = metadata(lines).select("snapshot", F.coalesce("os_name", F.lit("Linux")).alias("os_name"))
    rows = lines.drop("os_name").join(F.broadcast(meta), "snapshot")
    none = F.array().cast("array<string>")
    time = lambda c, i: F.get(F.get(F.col(c), F.col("pos")), F.lit(i))
    out = None
    for kind, names, times in (("f", "f", "t"), ("d", "d", "dir_times")):
        one = rows.select("snapshot", "seq", "p", "os_name", "s", "t", "dir_times", F.posexplode(F.coalesce(names, none)).alias("pos", "name"))
        size = F.coalesce(F.get("s", F.col("pos")), F.lit(0)) if kind == "f" else F.lit(None)
        one = one.select("snapshot", "seq", "pos", F.lit(kind).alias("kind"), F.col("p").alias("parent"), "name", join_path(F.col("p"), F.col("name"), F.col("os_name")).alias("full_path"), size.cast("long").alias("size"), time(times, 0).alias("created"), time(times, 1).alias("modified"), time(times, 2).alias("accessed"))
        out = one if out is None else out.unionByName(one)
    return out


def to_lines(dirs: DataFrame, entries: DataFrame) -> DataFrame:
    """(snapshot, seq, value): the JSON line of each directory."""
    item = F.struct("pos", "name", F.coalesce("size", F.lit(0)).alias("size"), F.array("created", "modified", "accessed").alias("times"))
    lists = entries.groupBy("snapshot", "seq").agg(F.array_sort(F.collect_list(F.when(F.col("kind") == "f", item))).alias("fs"), F.array_sort(F.collect_list(F.when(F.col("kind") == "d", item))).alias("ds"))
    both = dirs.join(lists, ["snapshot", "seq"], "left")
    names = [("path", "p", "string"), ("fs.name", "f", "array<string>"), ("ds.name", "d", "array<string>"), ("fs.times", "t", "array<array<bigint>>"), ("ds.times", "T", "array<array<bigint>>"), ("fs.size", "s", "array<bigint>")]
    value = [F.concat(F.lit(f'"{key}":'), F.coalesce(F.to_json(F.col(column)) if kind != "string" else _quoted(F.col(column)), F.lit("[]"))) for column, key, kind in names]
    return both.select("snapshot", "seq", F.concat(F.lit("{"), F.concat_ws(",", *value), F.lit("}")).alias("value"))


def _quoted(text):
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'^\{"v":(.*)\}$', 1)


def write_snapshot(dirs: DataFrame, entries: DataFrame, path: str, meta: dict | None = None) -> None:
    """One snapshot as a gzip JSON Lines file in line order; ``meta`` goes into its first line."""
    lines = to_lines(dirs, entries)
    if meta:
        more = json.dumps({k: meta[k] for k in META if meta.get(k) is not None})[1:]
        first = F.concat(F.left("value", F.length("value") - 1), F.lit(", " + more))
        lines = lines.withColumn("value", F.when(F.col("seq") == dirs.agg(F.min("seq")).first()[0], first).otherwise(F.col("value")))
    write_lines(lines.orderBy("seq"), path, "gzip")


def write_table(df: DataFrame, path: str) -> None:
    """The same as Parquet by snapshot, for scans that read few columns of few snapshots."""
    df.write.mode("overwrite").partitionBy("snapshot").parquet(path)


def _ascii_length(text):
    """Characters of a text as a JSON string in ASCII: quotes, short escapes of two and code units of six."""
    wide = F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", "xxxxxxxxxxxx")
    short = F.regexp_replace(wide, r'[\x08\t\n\f\r"\\]', "xx")
    return F.length(F.regexp_replace(short, r"[^\x20-\x7E]", "xxxxxx")) + 2


def index_projection(dirs: DataFrame, entries: DataFrame) -> DataFrame:
    """(snapshot, p, compressed_length): each directory and the length of its line without the path, as JSON in ASCII with ", " and ": ".

    The lengths are sums over the entries, so a directory of any size is added up where its entries are.
    """
    number = lambda c: F.coalesce(F.length(F.col(c).cast("string")), F.lit(4))
    stamp = number("created") + number("modified") + number("accessed") + 6
    file = F.col("kind") == "f"
    each = _ascii_length(F.col("name")) + stamp + 4 + F.when(file, F.length(F.coalesce("size", F.lit(0)).cast("string")) + 2).otherwise(0)
    sums = entries.groupBy("snapshot", "seq").agg(F.sum(each).alias("chars"), F.count_if(file).alias("nf"), F.count_if(~file).alias("nd"))
    met = dirs.join(sums, ["snapshot", "seq"], "left")
    # A list of n has n - 1 separators of two; three lists are of files, two of subdirectories.
    less = F.when(F.col("nf") > 0, 6).otherwise(0) + F.when(F.col("nd") > 0, 4).otherwise(0)
    empty = len(json.dumps({"f": [], "d": [], "t": [], "T": [], "s": []}))
    return met.select("snapshot", F.col("path").alias("p"), (F.lit(empty) + F.coalesce(F.col("chars") - less, F.lit(0))).cast("long").alias("compressed_length"))


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshot files of a folder, newest first: filename, size, modified, timestamp (0 if the name has none)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "snapshot_*.jsonl.gz").load(folder).select("path", "length", "modificationTime")
    rows = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.col("length").alias("size"), "modificationTime")
    indexed = [f for f in folders(spark, folder) if re.fullmatch(r"snapshot_.*\.jsonl\.gz", f[0])]  # a snapshot each
    if indexed:
        more = spark.createDataFrame(indexed, "filename string, size bigint, at bigint")
        rows = rows.unionByName(more.select("filename", "size", F.timestamp_seconds("at").alias("modificationTime")))
    return newest_first(listed(rows))


def newest_first(listed_files: DataFrame) -> DataFrame:
    return listed_files.orderBy(F.desc("timestamp"), "filename")


def listed(files: DataFrame) -> DataFrame:
    """The catalogue's columns of files (filename, size, modificationTime)."""
    stamp = F.coalesce(F.regexp_extract("filename", r"^snapshot_(\d+)_", 1).try_cast("bigint"), F.lit(0))
    return files.select("filename", "size", F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("modified"), F.unix_timestamp("modificationTime").alias("mtime"), stamp.alias("timestamp"))


def read_group_log(spark: SparkSession, path: str, snapshot: str) -> DataFrame:
    """(snapshot, seq, path, kind, group, action, ts) of one log, one JSON array a line; none if there is no log.

    ``seq`` orders the lines: those of the file ``path``, then the appended batches one after the other.
    """
    found = [p for p, at in ((path, path), (f"{path}.d/*", f"{path}.d")) if exists(spark, at)]
    if not found:
        return spark.createDataFrame([], LOG)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(found).select(place.alias("seq"), "value").where(F.trim("value") != "")
    item = F.from_json("value", T.ArrayType(T.StringType()))
    return lines.select(F.lit(snapshot).alias("snapshot"), "seq", *[F.get(item, F.lit(i)).alias(n) for i, n in enumerate(("path", "kind", "group", "action"))], F.get(item, F.lit(4)).try_cast("bigint").alias("ts"))


def append_group_actions(actions: DataFrame, path: str) -> None:
    """Appends (path, kind, group, action, ts) as JSON arrays: each call adds a batch beside the log file, named by the time in nanoseconds.

    Each partition of ``actions`` writes a file of its own, and their order is that of the partitions, so a batch of any size is in order.
    """
    parts = [*[_quoted(F.col(c)) for c in ("path", "kind", "group", "action")], F.col("ts").cast("string")]
    actions.select(F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]")).alias("value")).write.text(f"{path}.d/{time.time_ns():020d}")


def read_devices(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(DEVICE).json(f"{folder}/devices_*")


def append_device(device: DataFrame, folder: str, host: str) -> None:
    if "host_name" not in device.columns:
        raise ValueError("a device needs host_name")
    device.write.mode("append").json(f"{folder}/devices_{host}.jl")


def read_media(spark: SparkSession, folder: str, host: str) -> DataFrame:
    """A host's media; none if the host has no file."""
    path = f"{folder}/media_{host}.jl"
    if not exists(spark, path):
        return spark.createDataFrame([], MEDIA)
    return spark.read.schema(MEDIA).json(path)


def write_media(media: DataFrame, folder: str, host: str) -> None:
    media.write.mode("overwrite").json(f"{folder}/media_{host}.jl")


def host_known(devices: DataFrame, host: str) -> bool:
    return bool(devices.where(F.col("host_name") == host).limit(1).count())


def hosts_known(hosts: DataFrame, devices: DataFrame) -> DataFrame:
    """(host, known) of many hosts at once."""
    named = devices.select(F.col("host_name").alias("host"), F.lit(True).alias("known")).distinct()
    return hosts.join(named, "host", "left").select("host", F.coalesce("known", F.lit(False)).alias("known"))
