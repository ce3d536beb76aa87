"""A walk over file systems as rounds of DataFrames.

The directories still to visit are a table, dealt over the tasks in every round. A task walks on depth-first from each of its own
until it has met a bounded number of entries and hands back what is left, so a long chain is walked by one task in one
round, and a broad tree spreads over all of them. A directory with very many entries is listed once and cut by name
into pieces that different tasks look at. The driver lists nothing.
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.operators.ordered import running
from arborlake.sources.scratch import kept

#: Entries that a task looks at before it hands back the rest: in the first round, and in any.
FIRST_ENTRIES, MOST_ENTRIES = 500, 20_000
#: Entries of one piece of a wide directory.
PIECE = 5_000
#: Prefixes up to which each is a predicate of its own.
FEW_PREFIXES = 32
SCHEMA = "root string, path string, files array<string>, sizes array<bigint>, file_times array<array<bigint>>, dirs array<string>, dir_times array<array<bigint>>, errors array<string>"
_ROWS = "waiting boolean, piece int, names array<string>, " + SCHEMA
_STAMPS = pa.list_(pa.list_(pa.int64()))
_KINDS = [("waiting", pa.bool_()), ("piece", pa.int32()), ("names", pa.list_(pa.string())), ("root", pa.string()), ("path", pa.string()), ("files", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("file_times", _STAMPS), ("dirs", pa.list_(pa.string())), ("dir_times", _STAMPS), ("errors", pa.list_(pa.string()))]


class Prefixes:
    """Raw string prefixes, sorted and without those that another one covers: of these only the last before a path can cover it."""

    def __init__(self, prefixes: Iterable[str]) -> None:
        self.sorted: list[str] = []
        for p in sorted(p for p in prefixes if p):
            if not self.sorted or not p.startswith(self.sorted[-1]):
                self.sorted.append(p)

    def cover(self, path: str) -> bool:
        at = bisect.bisect_right(self.sorted, path)
        return at > 0 and path.startswith(self.sorted[at - 1])


def normal(path: str) -> str:
    return os.path.normcase(os.path.abspath(path))


def looked_at(path: str, names: list[str], skip: Prefixes) -> tuple[list, list[str]]:
    """What a directory's row says of the given entries, and the subdirectories to go on with (links are listed, not followed)."""
    files, sizes, times, dirs, dir_times, errors, down = [], [], [], [], [], [], []
    for name in names:
        full = os.path.join(path, name)
        if skip.cover(normal(full)):
            continue
        try:
            is_dir, s = os.path.isdir(full), os.stat(full)
        except OSError as e:
            errors.append(str(e))
            continue
        stamp = [int(s.st_ctime), int(s.st_mtime), int(s.st_atime)]
        if is_dir:
            dirs.append(name)
            dir_times.append(stamp)
            if not os.path.islink(full):
                down.append(full)
        else:
            files.append(name)
            sizes.append(s.st_size)
            times.append(stamp)
    return [files, sizes, times, dirs, dir_times, errors], down


def visited(work: list[tuple], skip: Prefixes, most: int, piece: int = PIECE) -> Iterator[tuple]:
    """Rows of the directories walked from ``work`` (root, path, piece number, names) and of those left after ``most`` entries."""
    left = most
    stack = list(reversed(work))
    while stack and left > 0:
        root, path, number, names = stack.pop()
        if names is None:
            try:
                names = sorted(e.name for e in os.scandir(path))
            except OSError as e:
                yield (False, None, None, root, path, [], [], [], [], [], [str(e)])
                continue
            if len(names) > piece:
                left -= piece
                stack[:0] = [(root, path, i // piece, names[i : i + piece]) for i in range(0, len(names), piece)]
                continue
        row, down = looked_at(path, names, skip)
        left -= len(names) + 1
        yield (False, number, None, root, path, *row)
        stack += [(root, d, None, None) for d in reversed(down)]
    for root, path, number, names in reversed(stack):
        yield (True, number, names, root, path, None, None, None, None, None, None)


def scan(spark: SparkSession, roots: list[str], skip: list[str] = (), first: int = FIRST_ENTRIES, most: int = MOST_ENTRIES, piece: int = PIECE) -> DataFrame:
    """One row per directory of all roots, as they were when this was called; counters are sums over this table."""
    covered = Prefixes(normal(p) for p in skip if p)
    todo = spark.createDataFrame([(r, r, None, None) for r in roots if not covered.cover(normal(r))], "root string, path string, piece int, names array<string>")
    done, entries, tasks = None, first, int(spark.conf.get("spark.sql.shuffle.partitions"))

    def walked(limit: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            work = [row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)]
            held: list[tuple] = []
            for row in visited(work, covered, limit, piece):
                held.append(row)
                if len(held) >= 1000 or len(row[2] or row[5] or ()) >= 1000:
                    yield _batch(held)
                    held = []
            yield _batch(held)

        return run

    while True:
        rows = kept(todo.repartition(tasks).mapInArrow(walked(entries), _ROWS))
        found = rows.where("NOT waiting").drop("waiting", "names")
        done = found if done is None else done.unionByName(found)
        todo = rows.where("waiting").select("root", "path", "piece", "names")
        if not todo.take(1):
            break
        entries = min(most, entries * 4)
    whole = done.where("piece IS NULL").drop("piece")
    columns = [c for c in whole.columns if c not in ("root", "path")]
    cut = done.where("piece IS NOT NULL")
    if not cut.take(1):
        return whole
    # A wide directory's row is put together from its pieces, in the order of their names.
    joined = cut.groupBy("root", "path").agg(F.array_sort(F.collect_list(F.struct("piece", *columns))).alias("x"))
    return whole.unionByName(joined.select("root", "path", *[F.flatten(F.col(f"x.{c}")).alias(c) for c in columns]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(_KINDS)], names=[n for n, _ in _KINDS])


def under_top(scanned: DataFrame, roots: list[str]) -> DataFrame:
    """The scan of several drives below one root "/", whose row lists the drives."""
    names = [r.rstrip("\\/") or r for r in roots]
    top = scanned.sparkSession.createDataFrame([("/", "/", [], [], [], [n.lstrip("/") for n in names], [[0, 0, 0]] * len(names), [])], SCHEMA)
    return top.unionByName(scanned.withColumn("root", F.lit("/")))


def numbered(scanned: DataFrame, folder: str) -> DataFrame:
    """The scan as a table in ``folder``, with ``seq`` from 0 on by root and path. Only the row counts of partitions pass through the driver."""
    spark = scanned.sparkSession
    scanned.repartitionByRange("root", "path").sortWithinPartitions("root", "path").withColumn("id", F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.parquet(folder).withColumn("part", F.shiftright("id", 33))
    counts = rows.groupBy("part").count().orderBy("part").collect()
    offsets, total = [], 0
    for r in counts:
        offsets.append((r.part, total - (r.part << 33)))
        total += r["count"]
    moved = rows.join(F.broadcast(spark.createDataFrame(offsets, "part long, moved long")), "part")
    return moved.withColumn("seq", F.col("id") + F.col("moved")).drop("id", "part", "moved")


def as_tables(scanned: DataFrame, snapshot: str, os_name: str = "Linux") -> tuple[DataFrame, DataFrame]:
    """``dirs`` and ``entries`` of a scan; directories that have no number take a hash of root and path."""
    from arborlake.functions.paths import join_path

    seq = F.col("seq") if "seq" in scanned.columns else F.xxhash64("root", "path")
    base = scanned.select(F.lit(snapshot).alias("snapshot"), seq.alias("seq"), "root", "path", "files", "sizes", "file_times", "dirs", "dir_times", F.lit(os_name).alias("os_name"))
    dirs = base.select("snapshot", "seq", "path", "root", "os_name", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("direct_size"), F.size("files").alias("n_files"), F.size("dirs").alias("n_subdirs"))
    out = None
    for kind, names, times in (("f", "files", "file_times"), ("d", "dirs", "dir_times")):
        one = base.select("snapshot", "seq", "path", "sizes", times, F.posexplode(names).alias("pos", "name"))
        stamp = [F.get(F.get(times, F.col("pos")), F.lit(i)).alias(n) for i, n in enumerate(("created", "modified", "accessed"))]
        one = one.select("snapshot", "seq", "pos", F.lit(kind).alias("kind"), F.col("path").alias("parent"), "name", join_path(F.col("path"), F.col("name"), F.lit(os_name)).alias("full_path"), (F.get("sizes", F.col("pos")) if kind == "f" else F.lit(None)).cast("long").alias("size"), *stamp)
        out = one if out is None else out.unionByName(one)
    return dirs, out


def without_prefixes(entries: DataFrame, prefixes: list[str] | DataFrame, column: str = "full_path") -> DataFrame:
    """The same pruning after the fact; raw string prefixes, as a list or as the table ``prefix``, of any length. A null path stays.

    Long lists are swept: every prefix covers an interval of the sorted paths, and a path is kept where none is open.
    """
    if isinstance(prefixes, list) and len(prefixes) <= FEW_PREFIXES:
        for p in prefixes:
            if p:
                entries = entries.where(F.coalesce(~F.startswith(F.col(column), F.lit(p)), F.lit(True)))
        return entries
    if isinstance(prefixes, list):
        prefixes = entries.sparkSession.createDataFrame([(p,) for p in prefixes], "prefix string")
    known = prefixes.where("prefix IS NOT NULL AND prefix != ''").select(F.col("prefix").cast("binary").alias("__at")).distinct()
    none = [F.lit(None).cast(entries.schema[c].dataType).alias(c) for c in entries.columns]
    # No UTF-8 text has the byte FF, so a prefix with it stands after all that begin with the prefix.
    opens = known.select(*none, "__at", F.lit(0).alias("__kind"), F.lit(1).cast("long").alias("__covers"))
    shuts = known.select(*none, F.concat("__at", F.unhex(F.lit("FF"))).alias("__at"), F.lit(2).alias("__kind"), F.lit(-1).cast("long").alias("__covers"))
    rows = entries.select("*", F.col(column).cast("binary").alias("__at"), F.lit(1).alias("__kind"), F.lit(0).cast("long").alias("__covers"))
    swept = running(rows.unionByName(opens).unionByName(shuts), [], ["__at", "__kind"], {"__covering": "__covers"})
    return swept.where("__kind = 1 AND __covering = 0").select(*entries.columns)


def overlaps(roots: DataFrame) -> DataFrame:
    """(path, n_same, n_above, n_below) of the roots (path, os_name) of scans: how often each is given, and how many others hold it or lie in it.

    Roots are swept in order of their components, so /a/b and /a/bc do not overlap; the work is a sort, whatever the number of pairs.
    """
    from arborlake.operators.tree import bracketed

    once = roots.where("path IS NOT NULL").groupBy("path").agg(F.count("*").alias("n_same"), F.max(F.coalesce("os_name", F.lit("Linux"))).alias("os_name"))
    marked = bracketed(once.select(F.lit("roots").alias("snapshot"), "path", F.lit("/").alias("root"), "os_name", "n_same"), {"open": F.lit(1), "begun": F.lit(1)}, columns=["n_same"])
    rows = marked.withColumn("open", F.when(F.col("is_open"), 1).otherwise(-1).cast("long"))
    seen = running(rows, ["snapshot"], ["at", "kind", F.desc("is_open")], {"n_open": "open", "n_begun": "begun"}).where("path IS NOT NULL")
    at_open = lambda c: F.max(F.when(F.col("is_open"), F.col(c)))
    return seen.groupBy("path").agg(F.max("n_same").alias("n_same"), (at_open("n_open") - 1).alias("n_above"), (F.max(F.when(~F.col("is_open"), F.col("n_begun"))) - at_open("n_begun")).alias("n_below"))


def counters(scanned: DataFrame) -> DataFrame:
    """scanned_count, scanned_size and n_errors of a scan, over all its roots."""
    return scanned.agg(F.sum(F.size("files") + F.size("dirs")).alias("scanned_count"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("scanned_size"), F.sum(F.size("errors")).alias("n_errors"))


def errors(scanned: DataFrame) -> DataFrame:
    """(root, path, error), one row an error."""
    return scanned.select("root", "path", F.explode("errors").alias("error"))
