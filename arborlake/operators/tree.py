"""Directory trees: direct and recursive totals, listings and look-ups.

``dirs`` has (snapshot, seq, path, root, os_name, direct_size, n_files, n_subdirs), ``entries``
(snapshot, seq, pos, kind, parent, name, full_path, size, created, modified, accessed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions.paths import format_bytes, to_web
from arborlake.operators.ordered import running
from arborlake.sources.scratch import kept


def last_of_path(dirs: DataFrame) -> DataFrame:
    """One row per path; of repeated paths the last in file order."""
    names = [c for c in dirs.columns if c not in ("snapshot", "path")]
    kept = dirs.groupBy("snapshot", "path").agg(F.max_by(F.struct(*names), "seq").alias("r"))
    return kept.select("snapshot", "path", *[F.col(f"r.{c}").alias(c) for c in names])


def direct_totals(entries: DataFrame) -> DataFrame:
    files = entries.where("kind = 'f'")
    return files.groupBy("snapshot", F.col("parent").alias("path")).agg(F.sum(F.coalesce("size", F.lit(0))).cast("long").alias("direct_size"), F.count("*").alias("n_files"))


def place(path: Column, root: Column, os_name: Column) -> Column:
    """The names below ``root`` as an array that sorts a tree in pre-order; null for a path that is not there.

    Every name has "0" before it, so an array that ends in CLOSE stands after all that begin as it does.
    """
    windows = os_name == "Windows"
    sep = F.when(windows, "\\").otherwise("/")
    base, drives = F.rtrim(root, sep), windows & (root == "/")
    tail = F.when(drives, path).otherwise(F.substr(path, F.length(base) + 1))
    names = F.filter(F.when(windows, F.split(tail, r"\\")).otherwise(F.split(tail, "/")), lambda n: n != "")
    below = drives | F.startswith(path, F.concat(base, sep))
    return F.when(path == root, F.array().cast("array<string>")).when(below, F.transform(names, lambda n: F.concat(F.lit("0"), n)))


#: Kinds of rows that stand at one place, in their order: what marks a subtree, its directory, what lies outside the root.
MARK, OPEN, STRAY = 0, 1, 2
#: The same at the end of a subtree.
SHUT, UNMARK = 0, 1
CLOSE = "1"


def bracketed(dirs: DataFrame, amounts: dict[str, Column], both: bool = True, columns: list[str] = ()) -> DataFrame:
    """(snapshot, root, at, kind, path, is_open, amounts): a row where each subtree begins, with its directory's amounts, and one where it ends."""
    at = place(F.col("path"), F.col("root"), F.col("os_name"))
    inside = at.isNotNull()
    rows = dirs.select("snapshot", "root", F.coalesce(at, F.array().cast("array<string>")).alias("at"), F.when(inside, OPEN).otherwise(STRAY).alias("kind"), F.when(inside, F.col("path")).alias("path"), F.lit(True).alias("is_open"), *[v.cast("long").alias(k) for k, v in amounts.items()], *columns)
    if not both:
        return rows
    none = [F.lit(None).cast(dirs.schema[c].dataType).alias(c) for c in columns]
    ends = rows.where("path IS NOT NULL").select("snapshot", "root", F.concat("at", F.array(F.lit(CLOSE))).alias("at"), F.lit(SHUT).alias("kind"), "path", F.lit(False).alias("is_open"), *[F.lit(0).cast("long").alias(k) for k in amounts], *none)
    return rows.unionByName(ends)


def reachable(dirs: DataFrame, entries: DataFrame) -> DataFrame:
    """Directories to which listed subdirectories lead from the root: every ancestor below the root is there and listed.

    A directory that is not listed, or whose parent is not there, bars its subtree. Bars that are open are counted in
    pre-order, so the work does not grow with the depth.
    """
    listed = entries.where("kind = 'd'").select("snapshot", F.col("full_path").alias("path"), F.lit(True).alias("__listed")).distinct()
    at = place(F.col("path"), F.col("root"), F.col("os_name"))
    placed = dirs.withColumn("__at", at)
    there = placed.select("snapshot", "root", F.col("__at").alias("__up"), F.lit(True).alias("__parent")).where("__up IS NOT NULL").distinct()
    up = F.when(F.size("__at") > 1, F.slice("__at", F.lit(1), F.size("__at") - 1))
    met = placed.withColumn("__up", up).join(there, ["snapshot", "root", "__up"], "left").join(listed, ["snapshot", "path"], "left")
    deep = F.coalesce(F.size("__at") > 0, F.lit(False))
    bars = deep & (F.col("__listed").isNull() | ((F.size("__at") > 1) & F.col("__parent").isNull()))
    rest = [c for c in dirs.columns if c not in ("snapshot", "root", "path")]
    opens = bracketed(met.withColumn("__path", F.col("path")), {"__bars": bars}, both=False, columns=[*rest, "__at", "__path"])
    shuts = opens.where("__bars > 0").withColumns({"at": F.concat("at", F.array(F.lit(CLOSE))), "kind": F.lit(UNMARK), "is_open": F.lit(False), "__bars": -F.col("__bars")})
    counted = running(opens.unionByName(shuts), ["snapshot", "root"], ["at", "kind"], {"__open_bars": "__bars"})
    return counted.where("is_open AND __open_bars = 0").select(*[F.col("__path").alias("path") if c == "path" else F.col(c) for c in dirs.columns])


def rollup(dirs: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(snapshot, path, S, C): sizes and file counts of each directory and all below it.

    In pre-order a subtree is an interval, so its totals are differences of running sums: two rows a directory are
    sorted, whatever the depth. Given the entries, unreachable directories keep their direct totals.
    """
    # Written once: the sort by range reads its input twice, and each directory stands in it twice.
    inside = kept(dirs.select("snapshot", "path", "root", "os_name", "direct_size", "n_files")) if entries is None else reachable(dirs, entries)
    totals = sums_within(bracketed(inside, {"direct_size": F.coalesce("direct_size", F.lit(0)), "n_files": F.coalesce("n_files", F.lit(0))}), ["snapshot", "root"], {"S": "direct_size", "C": "n_files"})
    if entries is not None:
        alone = dirs.join(inside.select("snapshot", "path"), ["snapshot", "path"], "left_anti")
        totals = totals.unionByName(alone.groupBy("snapshot", "path").agg(F.sum("direct_size").cast("long").alias("S"), F.sum("n_files").cast("long").alias("C")))
    return totals


def sums_within(rows: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """(snapshot, path, sums) of each subtree of bracketed rows."""
    added = running(rows, keys, ["at", "kind"], {f"__{n}": c for n, c in sums.items()})
    begin = lambda n, c: F.min(F.when(F.col("is_open"), F.col(f"__{n}") - F.col(c)))
    whole = added.where("path IS NOT NULL").groupBy("snapshot", "path").agg(*[(F.max(F.when(~F.col("is_open"), F.col(f"__{n}"))) - begin(n, c)).alias(n) for n, c in sums.items()])
    return whole


def info(dirs: DataFrame) -> DataFrame:
    """Totals of each snapshot over all its rows, reachable or not."""
    out = dirs.groupBy("snapshot").agg(F.count("*").alias("path_count"), F.sum("n_files").cast("long").alias("total_files"), F.sum("n_subdirs").cast("long").alias("total_dirs"), F.sum("direct_size").cast("long").alias("total_size"), F.min_by("path", "seq").alias("root_path"))
    return out.withColumn("total_size_formatted", format_bytes(F.col("total_size")))


def lookup(dirs: DataFrame, path: str | None = None, index: int | None = None) -> DataFrame:
    if (path is None) == (index is None):
        raise ValueError("give either a path or an index")
    return dirs.where(F.col("path") == path if path is not None else F.col("seq") == index)


def list_files(entries: DataFrame, path: str | None = None) -> DataFrame:
    files = entries.where("kind = 'f'")
    if path is not None:
        files = files.where(F.col("parent") == path)
    return files.select("snapshot", "parent", "name", F.coalesce("size", F.lit(0)).cast("long").alias("size"), "created", "modified", "accessed").withColumn("size_formatted", format_bytes(F.col("size")))


def list_dirs(entries: DataFrame, totals: DataFrame, path: str | None = None) -> DataFrame:
    """Subdirectories with recursive totals; those that have no row of their own (links, unreadable ones) have null totals."""
    subdirs = entries.where("kind = 'd'")
    if path is not None:
        subdirs = subdirs.where(F.col("parent") == path)
    child = totals.select("snapshot", F.col("path").alias("full_path"), "S", "C")
    return subdirs.join(child, ["snapshot", "full_path"], "left").select("snapshot", "parent", "name", "S", "C").withColumn("size_formatted", format_bytes(F.col("S")))


def page(dirs: DataFrame, totals: DataFrame, path: str) -> DataFrame:
    """A directory's own line: web path, S, C and the formatted total."""
    own = dirs.where(F.col("path") == path).join(totals, ["snapshot", "path"], "left")
    return own.select("snapshot", to_web(F.col("path"), F.col("os_name")).alias("current_path"), "S", "C", format_bytes(F.col("S")).alias("total_size_formatted"))


def progress(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Whole percent done after each row of its key; rows are ranked by range, so a key is spread over many tasks."""
    ranked = running(rows, keys, order, rank="__rank")
    counts = ranked.groupBy(*keys).agg(F.max("__rank").alias("__last"))
    met = ranked.join(counts.select(*[F.col(k).alias(f"__of_{k}") for k in keys], "__last"), [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys])
    return met.select(*rows.columns, F.floor((F.col("__rank") + 1) * 100 / (F.col("__last") + 1)).cast("long").alias("percent"))
