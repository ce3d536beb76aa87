"""Backups: volumes of bounded size, the manifest, and the writers."""

from __future__ import annotations

import os
import shutil
import time
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.functions.paths import member_name, volume_name
from arborlake.operators.ordered import PART, ROW, groups, new_runs, running
from arborlake.sources.scratch import kept
from arborlake.sources.single import write_lines

VOLUME_BYTES = 100 * 1024 * 1024
LEVEL = 6
#: Rows that a task packs at once.
BLOCK = 1 << 16
MANIFEST = "timestamp long, src_path string, dest_path string, filesize long, action string, result string"


def with_sources(files: DataFrame) -> DataFrame:
    """``files`` with source_exists, as the machines that run the tasks see it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            there = [p is not None and os.path.exists(p) for p in b.column("full_path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(there, pa.bool_())], names=[*b.schema.names, "source_exists"])

    return files.mapInArrow(run, files.select("*", F.lit(True).alias("source_exists")).schema)


def _chain(asks: np.ndarray, before: np.ndarray, max_bytes: int) -> np.ndarray:
    """For each file of a stretch, as the first of a volume: the file that starts the next one, or the stretch's length.

    File i opens a volume after one that began at s if ``asks[i] > before[s] + max_bytes``, where ``before`` is what the
    files before one add up to and ``asks[i]`` is ``before[i]`` and its own size, at most ``max_bytes``: so a file that is larger than
    a volume opens one exactly if the current one holds bytes.
    """
    return np.searchsorted(np.maximum.accumulate(asks), before + max_bytes, side="right")


def _stretches(block: pa.Table) -> list[tuple[int, int]]:
    cuts = [*np.flatnonzero(new_runs([block.column("__key").combine_chunks()], None)).tolist(), block.num_rows]
    return list(zip(cuts, cuts[1:], strict=False))


def _numbers(block: pa.Table, name: str) -> np.ndarray:
    return block.column(name).to_numpy().astype(np.int64)


def _ways(placed: DataFrame, max_bytes: int) -> DataFrame:
    """What a volume that is open at the begin of a block of rows does in it: (key, block, kind, hi, exit, hops, high).

    A volume that began where ``b`` bytes were packed ends in the block at the first file that asks for more than
    b + max_bytes. Files with the same last volume of the block behind them are one way (kind 0), named by the most that
    is asked for up to its last file (hi); ``exit`` is where the last volume has to end and ``hops`` how many begin. Kind 1 begins
    with the key; kind 2 has the most that the block asks for.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in groups(batches, "__block"):
            out, stretches = [], _stretches(block)
            number = block.column("__block")[0].as_py()
            for a, z in dict.fromkeys([stretches[0], stretches[-1]]):
                asks, before = _numbers(block.slice(a, z - a), "__asks"), _numbers(block.slice(a, z - a), "__before")
                begins = block.column("__rank")[a].as_py() == 0
                if begins and z < block.num_rows:
                    continue  # the whole key is in the block
                key, n = block.column("__key")[a].as_py(), z - a
                following, leave, hops = _chain(asks, before, max_bytes).tolist(), list(range(n)), [1] * n
                for i in range(n - 1, -1, -1):
                    if following[i] < n:
                        leave[i], hops[i] = leave[following[i]], hops[following[i]] + 1
                high = np.maximum.accumulate(asks)
                if begins:
                    out.append((key, number, 1, None, int(before[leave[0]]) + max_bytes, hops[0], -1))
                else:
                    lower = np.r_[np.iinfo(np.int64).min, high[:-1]]
                    last = None
                    for i in np.flatnonzero((high > lower) & (lower <= before[0] + max_bytes)).tolist():
                        if last == (leave[i], hops[i]):
                            out.pop()
                        last = (leave[i], hops[i])
                        out.append((key, number, 0, int(high[i]), int(before[leave[i]]) + max_bytes, hops[i], -1))
                out.append((key, number, 2, None, None, None, int(high[-1])))
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["__key", "__block", "kind", "hi", "exit", "hops", "high"])

    slim = placed.select("__key", "__block", "__row", "__asks", "__before", "__rank")
    return slim.repartition("__block").sortWithinPartitions("__block", "__row").mapInArrow(run, "__key string, __block long, kind int, hi long, exit long, hops long, high long")


def _entries(ways: DataFrame) -> DataFrame:
    """(block, base, entry, number) of the blocks that begin amid a key: the volume that is open there, where it ends and the number of the one after."""
    seen = running(ways, ["__key"], ["__block", "kind"], highs={"known": "high"})
    # What an earlier block asks for already ends the volume there.
    nodes = kept(seen.where("kind = 1 OR (kind = 0 AND hi > known)").select("__key", "__block", "hi", "exit", "hops"))
    targets = nodes.where("hi IS NOT NULL").select("__key", F.col("hi").alias("value"), F.lit(1).alias("is_target"), "hi")
    asking = nodes.select("__key", F.col("exit").alias("value"), F.lit(0).alias("is_target"), "hi")
    # The first way above a volume's end has as many ways above itself as the end has.
    met = running(targets.unionByName(asking), ["__key"], [F.desc("value"), "is_target"], {"above": "is_target"})
    to = met.where("is_target = 1").select("__key", "above", F.col("hi").alias("to"))
    steps = met.where("is_target = 0").select("__key", "above", "hi").join(to, ["__key", "above"]).select("__key", "hi", "to")
    first = steps.where("hi IS NULL").join(nodes.where("hi IS NULL").select("__key", "exit", "hops"), "__key")
    reached = kept(first.select("__key", F.col("to").alias("hi"), F.col("hops").alias("number"), F.col("exit").alias("entry")))
    jumps = kept(steps.where("hi IS NOT NULL").join(nodes.select("__key", "hi", "exit", "hops"), ["__key", "hi"]))
    while jumps.take(1):  # each round doubles how far the reached volumes are followed
        more = reached.join(jumps, ["__key", "hi"]).select("__key", F.col("to").alias("hi"), (F.col("number") + F.col("hops")).alias("number"), F.col("exit").alias("entry"))
        reached = kept(reached.unionByName(more))
        onward = jumps.select("__key", F.col("hi").alias("to"), F.col("to").alias("end"), F.col("hops").alias("further"), F.col("exit").alias("final"))
        jumps = kept(jumps.join(onward, ["__key", "to"]).select("__key", "hi", F.col("end").alias("to"), F.col("final").alias("exit"), (F.col("hops") + F.col("further")).alias("hops")))
    at = reached.join(nodes.where("hi IS NOT NULL").select("__key", "hi", "__block", "hops"), ["__key", "hi"])
    begun = nodes.where("hi IS NULL").select("__key", "__block", F.lit(1).alias("kind"), (F.col("hops") - 1).alias("last"))
    ended = at.select("__key", "__block", F.lit(1).alias("kind"), (F.col("number") + F.col("hops") - 1).alias("last"))
    blocks = ways.where("kind = 2").select("__key", "__block", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("last"))
    bases = running(blocks.unionByName(begun).unionByName(ended), ["__key"], ["__block", "kind"], highs={"base": "last"}).where("kind = 0 AND base >= 0")
    return bases.select("__key", "__block", "base").join(at.select("__key", "__block", "entry", "number"), ["__key", "__block"], "left")


def pack(files: DataFrame, keys: list[str], order: list[str], max_bytes: int = VOLUME_BYTES, block: int = BLOCK) -> DataFrame:
    """``files`` with zip_index: in order, a new volume starts when the current one holds bytes and the next file does not fit.

    A file whose source_exists, if there is that column, is false adds no bytes to its volume. A null size is 0.

    Where a volume ends depends on all files before it, yet no task reads a whole key: rows are sorted by range with
    running sums, each block of rows finds the ways through it, and the ways that the volumes take are followed from
    the key's begin by pointer doubling. Then every block numbers its own files.
    """
    there = F.coalesce("source_exists", F.lit(False)) if "source_exists" in files.columns else F.lit(True)
    size, names = F.coalesce("size", F.lit(0)).cast("long"), files.columns
    sized = files.withColumns({"__key": F.to_json(F.struct(*keys)) if keys else F.lit(""), "__adds": F.when(there, size).otherwise(F.lit(0).cast("long")), "__size": F.least(size, F.lit(max_bytes))})
    placed = running(sized, ["__key"], order, {"__sum": "__adds"}, rank="__rank")
    before = F.col("__sum") - F.col("__adds")
    number = F.shiftleft(F.col(PART).cast("long"), 32) + F.floor(F.col(ROW) / block)
    placed = placed.withColumns({"__block": number, "__before": before, "__asks": before + F.col("__size"), "__row": F.col(ROW)})
    ways = kept(_ways(placed, max_bytes))
    rows = placed.select(*files.columns, "__key", "__block", "__row", "__rank", "__before", "__asks", *[F.lit(None).cast("long").alias(c) for c in ("base", "entry", "number")])
    if ways.where("kind = 0").take(1):
        heads = kept(_entries(ways))
        empty = [F.lit(None).cast(files.schema[c].dataType).alias(c) for c in files.columns]
        rows = rows.unionByName(heads.select(*empty, "__key", "__block", F.lit(-1).cast("long").alias("__row"), *[F.lit(0).cast("long").alias(c) for c in ("__rank", "__before", "__asks")], "base", "entry", "number"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "__block"):
            head = None
            if table.column("__row")[0].as_py() < 0:
                head, table = table.slice(0, 1), table.slice(1)
            index = np.zeros(table.num_rows, dtype=np.int64)
            for a, z in _stretches(table):
                asks, before = _numbers(table.slice(a, z - a), "__asks"), _numbers(table.slice(a, z - a), "__before")
                following, at, volume = _chain(asks, before, max_bytes).tolist(), 0, 0
                if table.column("__rank")[a].as_py() > 0:
                    base, entry, number = (head.column(c)[0].as_py() for c in ("base", "entry", "number"))
                    at = z - a if entry is None else int(np.searchsorted(np.maximum.accumulate(asks), entry, side="right"))
                    index[a : a + at] = base
                    volume = number
                while at < z - a:
                    index[a + at : a + following[at]] = volume
                    at, volume = following[at], (volume + 1)
            out = table.select(names).append_column("zip_index", pa.array(index, pa.int64()))
            yield from out.to_batches(max_chunksize=1 << 16)

    dealt = rows.repartition("__block").sortWithinPartitions("__block", "__row")
    return dealt.mapInArrow(run, files.select("*", F.lit(0).cast("long").alias("zip_index")).schema)


def volumes(packed: DataFrame, keys: list[str]) -> DataFrame:
    """``packed`` with ``volume``: volumes numbered over all keys, so that no two keys share one."""
    if not keys:
        return packed.withColumn("volume", F.col("zip_index"))
    # One row a key is added up in order; keys are compared with nulls as values.
    key = F.to_json(F.struct(*keys))
    counts = packed.groupBy(key.alias("__key")).agg((F.max("zip_index") + 1).alias("n"))
    first = running(counts, [], ["__key"], {"upto": "n"}).select("__key", (F.col("upto") - F.col("n")).alias("__first"))
    return packed.withColumn("__key", key).join(first, "__key").select(*packed.columns, (F.col("__first") + F.col("zip_index")).alias("volume"))


def manifest(packed: DataFrame, target: str) -> DataFrame:
    """The plan of a zip backup: source, volume, member and size; what a dry run returns. ``packed`` has ``volume``, see ``volumes``."""
    return packed.select(F.col("full_path").alias("src_path"), F.concat(F.lit(target.rstrip("/") + "/"), volume_name(F.col("volume"))).alias("dest_path"), member_name(F.col("full_path")).alias("member"), F.col("size").alias("filesize"), F.lit("zip").alias("action"), *(["source_exists"] if "source_exists" in packed.columns else []))


def header(spark, target_name: str, name: str, snapshot: str, backup_type: str, target: str, filter_in: list[str], filter_out: list[str]) -> DataFrame:
    row = (int(time.time()), target_name, name, snapshot, backup_type, target, list(filter_in), list(filter_out))
    return spark.createDataFrame([row], "timestamp long, backup_target_name string, backup_name string, snapshot string, backup_type string, target_path string, filter_in array<string>, filter_out array<string>")


def write_log(head: DataFrame, done: DataFrame, path: str) -> None:
    """The backup's log as JSON Lines: the header, then a line for each file, in order of volumes and sources."""
    first = head.select(F.lit(0).alias("n"), F.lit("").alias("dest_path"), F.lit("").alias("src_path"), F.to_json(F.struct(*head.columns)).alias("value"))
    lines = done.select(F.lit(1).alias("n"), "dest_path", "src_path", F.to_json(F.struct(*done.columns)).alias("value"))
    write_lines(first.unionByName(lines).orderBy("n", "dest_path", "src_path"), path)


def _result(rows: list[tuple]) -> pa.RecordBatch:
    names = ["timestamp", "src_path", "dest_path", "filesize", "action", "result"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _add(archive: zipfile.ZipFile, source: str) -> None:
    """Adds a file; of one that fails midway nothing stays. Times before 1980, which archives cannot hold, become 1980."""
    begin, members = archive.fp.tell(), len(archive.filelist)
    try:
        archive.write(source, source.lstrip("/")) if os.path.isdir(source) else _stream(archive, source)
    except Exception:
        for info in archive.filelist[members:]:
            archive.NameToInfo.pop(info.filename, None)
        del archive.filelist[members:]
        archive.fp.seek(begin)
        archive.fp.truncate()
        archive.start_dir = begin
        raise


def _stream(archive: zipfile.ZipFile, source: str) -> None:
    info = zipfile.ZipInfo.from_file(source, source.lstrip("/"), strict_timestamps=False)
    info.compress_type, info.compress_level = archive.compression, archive.compresslevel
    with open(source, "rb") as f, archive.open(info, "w", force_zip64=info.file_size > 1 << 30) as out:
        shutil.copyfileobj(f, out, 1 << 20)


def write_zip(packed: DataFrame, target: str, level: int = LEVEL) -> DataFrame:
    """Writes each volume in one task, file by file, and returns a manifest line per file; ``packed`` has ``volume``, see ``volumes``.

    A volume is written under another name and renamed when whole, so a repeated task replaces it. A file that
    cannot be added, for whatever reason, is logged and left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(target, exist_ok=True)
        index, archive, part, path = None, None, "", ""

        def close() -> None:
            if archive is not None:
                archive.close()
                os.replace(part, path)

        for b in batches:
            rows = []
            for volume, source, size in zip(b.column("volume").to_pylist(), b.column("full_path").to_pylist(), b.column("size").to_pylist(), strict=True):
                if volume != index:
                    close()
                    index, path = volume, os.path.join(target, f"backup_{volume:03d}.zip")
                    part = f"{path}.{uuid.uuid4().hex}.part"
                    archive = zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED, compresslevel=level)
                try:
                    _add(archive, source)
                    rows.append((int(time.time()), source, path, size, "zip", "success"))
                except Exception as e:  # the backup goes on after any one file
                    rows.append((int(time.time()), source, path, size, "failed", str(e)))
            yield _result(rows)
        close()

    return packed.select("volume", "seq", "pos", "full_path", "size").repartition("volume").sortWithinPartitions("volume", "seq", "pos").mapInArrow(run, MANIFEST)


def copy_folder(files: DataFrame, target: str) -> DataFrame:
    """Copies files with their directories and times, and returns a manifest line per file."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for source, size in zip(b.column("full_path").to_pylist(), b.column("size").to_pylist(), strict=True):
                path = os.path.join(target, source.lstrip("/"))
                try:
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    shutil.copy2(source, path)
                    rows.append((int(time.time()), source, path, size, "copy", "success"))
                except OSError as e:
                    rows.append((int(time.time()), source, path, size, "failed", str(e)))
            yield _result(rows)

    return files.select("full_path", "size").mapInArrow(run, MANIFEST)
