"""One object with the operations of the inventory service."""

from __future__ import annotations

import platform
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions.paths import to_native
from arborlake.operators import backup, content, groups, name_index, search, tree
from arborlake.sources import filesystem, host, indexed, snapshots
from arborlake.sources.single import exists


class Hub:
    """Snapshots, groups and devices below ``data_path``."""

    def __init__(self, spark: SparkSession, data_path: str):
        self.spark, self.data_path = spark, data_path.rstrip("/")
        self.loaded: dict[str, dict[str, DataFrame]] = {}

    def snapshots(self) -> DataFrame:
        return snapshots.catalogue(self.spark, f"{self.data_path}/snapshots").withColumn("loaded", F.regexp_replace("filename", r"\.jsonl\.gz$", "").isin(list(self.loaded)))

    scans = snapshots

    def scan(self, roots: list[str], skip: list[str] = (), save: bool = False, os_name: str | None = None, use_index: bool = False) -> tuple[DataFrame, DataFrame]:
        """A walk of the roots as a table below ``data_path``; saved, it is a snapshot file, or with an index a folder, that ``snapshots`` lists and ``load`` takes."""
        began, system = int(time.time()), os_name or platform.system()
        walked = filesystem.scan(self.spark, roots, skip)
        if len(roots) > 1 and system == "Windows":
            walked = filesystem.under_top(walked, roots)
        rows = filesystem.numbered(walked, f"{self.data_path}/scans/{began}-{uuid.uuid4().hex}")
        name = f"snapshot_{began}_{rows.count()}"
        dirs, entries = filesystem.as_tables(rows, name, system)
        if save:
            device = host.system_info(self.spark).first().asDict()
            meta = device | {"device_id": device["thumbprint"], "cpu_name": device["cpu_model"], "os_name": system, "start_scan_time": began, "finish_scan_time": int(time.time())}
            write = indexed.write_indexed if use_index else snapshots.write_snapshot
            write(dirs, entries, f"{self.data_path}/snapshots/{name}.jsonl.gz", meta)
        return dirs, entries

    def load(self, name: str) -> None:
        path = f"{self.data_path}/snapshots/{name}.jsonl.gz"
        if not exists(self.spark, path):
            raise KeyError(f"there is no snapshot {name}")
        has_index = exists(self.spark, f"{path}/{indexed.INDEX_FOLDER}")
        lines = (indexed.read_indexed(self.spark, path) if has_index else snapshots.read_lines(self.spark, path)).cache()
        if lines.isEmpty():
            raise ValueError(f"snapshot {name} has no lines")
        dirs, entries = tree.last_of_path(snapshots.dirs_of(lines)), snapshots.entries_of(lines)
        self.loaded[name] = {"lines": lines, "dirs": dirs, "entries": entries, "totals": tree.rollup(dirs, entries).cache()}
        for kind in ("dirs", "entries", "totals"):
            self.loaded[name][kind].createOrReplaceTempView(f"{name}_{kind}")

    def unload(self, name: str) -> None:
        held = self._of(name)
        del self.loaded[name]
        for kind in ("lines", "totals"):
            held[kind].unpersist()
        for kind in ("dirs", "entries", "totals"):
            self.spark.catalog.dropTempView(f"{name}_{kind}")

    def _of(self, name: str) -> dict[str, DataFrame]:
        if not name:
            raise ValueError("name a snapshot")
        if name not in self.loaded:
            raise KeyError(f"snapshot {name} is not loaded")
        return self.loaded[name]

    def group_log(self, name: str) -> DataFrame:
        return snapshots.read_group_log(self.spark, f"{self.data_path}/snapshots/{name}_groups.jl", name)

    def groups(self, name: str) -> DataFrame:
        return groups.replay(self.group_log(name))

    def group_counts(self, name: str) -> DataFrame:
        return groups.counts(self.group_log(name))

    def group_members(self, name: str, group: str) -> DataFrame:
        return groups.members(self.groups(name), group)

    def _log(self, name: str, paths: list[str], kind: str, group: str, action: str) -> None:
        if not paths or not group:
            raise ValueError("name a path and a group")
        rows = [(p, kind, group, action, int(time.time())) for p in paths]
        snapshots.append_group_actions(self.spark.createDataFrame(rows, "path string, kind string, group string, action string, ts bigint").coalesce(1), f"{self.data_path}/snapshots/{name}_groups.jl")

    def group_add(self, name: str, paths: list[str], kind: str, group: str) -> None:
        self._log(name, paths, kind, group, "add")

    def group_remove(self, name: str, paths: list[str], kind: str, group: str) -> None:
        self._log(name, paths, kind, group, "del")

    def list_path(self, name: str, path: str | None = None, index: int | None = None, filter_in: list[str] = (), filter_out: list[str] = (), recursive: bool = False) -> dict[str, DataFrame]:
        """The page of a directory: own totals, files and subdirectories."""
        held = self._of(name)
        if (path is None) == (index is None):
            raise ValueError("give either a path or an index")
        if path is not None:
            system = held["dirs"].first().os_name
            path = self.spark.range(1).select(to_native(F.lit(path), F.lit(system)).alias("p")).first().p
        found = tree.lookup(held["dirs"], path=path, index=index).first()
        if found is None:
            raise LookupError(f"snapshot {name} has no directory {path if index is None else f'number {index}'}")
        path = found.path
        entries, totals = held["entries"].where(F.col("parent") == path), held["totals"]
        if filter_in or filter_out:
            entries = groups.filter_listing(entries, self.groups(name), filter_in, filter_out)
            if recursive:
                totals = groups.filtered_totals(held["entries"], tree.reachable(held["dirs"], held["entries"]), self.groups(name), filter_in, filter_out)
        return {"page": tree.page(held["dirs"], held["totals"], path), "files": tree.list_files(entries), "dirs": tree.list_dirs(entries, totals)}

    def info(self, name: str) -> DataFrame:
        return tree.info(self._of(name)["dirs"])

    def _names(self, name: str) -> str:
        return f"{self.data_path}/names/{name}"

    def index_names(self, name: str) -> None:
        """Builds an index of a loaded snapshot's names, which later searches use."""
        name_index.build(self._of(name)["entries"], self._names(name))

    def search(self, query: str, names: list[str], by: str | None = None, descending: bool = False) -> DataFrame:
        missing = [n for n in names if n not in self.loaded]
        if missing:
            raise KeyError("not loaded: " + ", ".join(missing))
        out = None
        for n in names:
            at = self._names(n)
            hits = name_index.indexed_search(self.spark, at, query) if exists(self.spark, at) else search.search(self.loaded[n]["entries"], query)
            out = hits if out is None else out.unionByName(hits)
        return search.in_order(out, by, descending) if by else out

    def select(self, name: str, filter_in: list[str] = (), filter_out: list[str] = (), mode: str = "strict") -> DataFrame:
        held = self._of(name)
        return groups.select(held["entries"], tree.reachable(held["dirs"], held["entries"]), self.groups(name), filter_in, filter_out, mode)

    def hashes(self, name: str, filter_in: list[str] = (), filter_out: list[str] = (), algorithm: str = "sha256") -> DataFrame:
        return content.hash_files(self.select(name, filter_in, filter_out), algorithm)

    def duplicates(self, name: str) -> DataFrame:
        files = self.select(name)
        return content.duplicates(self.hashes(name).join(files, F.col("file_path") == F.col("full_path")))

    def plan_backup(self, name: str, target: str, filter_in: list[str] = (), filter_out: list[str] = (), max_bytes: int = backup.VOLUME_BYTES) -> DataFrame:
        """The volumes by the snapshot's sizes, and whether each source is there; when the backup runs, missing ones add no bytes."""
        packed = backup.pack(self.select(name, filter_in, filter_out), ["snapshot"], ["seq", "pos"], max_bytes)
        return backup.manifest(backup.with_sources(backup.volumes(packed, ["snapshot"])), target)

    def run_backup(self, name: str, target: str, kind: str = "zip", filter_in: list[str] = (), filter_out: list[str] = (), max_bytes: int = backup.VOLUME_BYTES) -> DataFrame:
        """Writes the backup and its log; returns the log's lines. What the tasks did is written first, so it is done once."""
        files, began = self.select(name, filter_in, filter_out), int(time.time())
        if kind == "folder":
            done = backup.copy_folder(files, target)
        else:
            packed = backup.pack(backup.with_sources(files), ["snapshot"], ["seq", "pos"], max_bytes)
            done = backup.write_zip(backup.volumes(packed, ["snapshot"]), target)
        at = f"{self.data_path}/backups/{began}-{uuid.uuid4().hex}"
        done.write.parquet(at)
        done = self.spark.read.parquet(at)
        label = target.rstrip("/").rpartition("/")[2]
        head = backup.header(self.spark, label, name, name, kind, target, filter_in, filter_out)
        backup.write_log(head, done, f"{self.data_path}/backups/{label}_{name}_{done.count()}_{began}.jl")
        return done

    def devices(self) -> DataFrame:
        return snapshots.read_devices(self.spark, f"{self.data_path}/devices")

    def add_device(self, device: DataFrame, media: DataFrame | None = None) -> None:
        host = device.first().host_name
        snapshots.append_device(device, f"{self.data_path}/devices", host)
        if media is not None:
            snapshots.write_media(media, f"{self.data_path}/devices", host)

    def media(self, host: str) -> DataFrame:
        return snapshots.read_media(self.spark, f"{self.data_path}/devices", host)
