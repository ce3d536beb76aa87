"""Group membership: log replay, counts, listing filters and selection of subtrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.operators.ordered import running
from arborlake.operators.tree import CLOSE, MARK, UNMARK, bracketed, place, sums_within
from arborlake.sources.scratch import kept


def replay(log: DataFrame) -> DataFrame:
    """(snapshot, group, kind, path) of the members after the log; the order of lines decides, not their times."""
    known = log.where(F.col("action").isin("add", "del"))
    last = known.groupBy("snapshot", "group", "kind", "path").agg(F.max_by("action", "seq").alias("action"))
    return last.where("action = 'add'").drop("action")


def counts(log: DataFrame) -> DataFrame:
    """Files, directories and both per group; a group that was ever named stays listed."""
    last = log.where(F.col("action").isin("add", "del")).groupBy("snapshot", "group", "kind", "path").agg(F.max_by("action", "seq").alias("action"))
    live = lambda kind: F.count_if((F.col("kind") == kind) & (F.col("action") == "add"))
    return last.groupBy("snapshot", "group").agg(live("f").alias("files"), live("d").alias("dirs")).withColumn("total", F.col("files") + F.col("dirs"))


def members(groups: DataFrame, group: str) -> DataFrame:
    return groups.where(F.col("group") == group)


def _named(groups: DataFrame, names: list[str], kind: str, column: str) -> DataFrame:
    return groups.where(F.col("group").isin(list(names)) & (F.col("kind") == kind)).select("snapshot", F.col("path").alias(column)).distinct()


def _marks(dirs: DataFrame, marked: DataFrame, column: str) -> DataFrame:
    """Rows as ``bracketed`` has them, where the subtrees of the marked paths begin and end; the root itself marks nothing."""
    roots = dirs.select("snapshot", "root", "os_name").distinct()
    at = place(F.col("path"), F.col("root"), F.col("os_name"))
    placed = marked.join(roots, "snapshot").withColumn("at", at).where(F.size("at") > 0)
    steps = F.array(F.struct(F.col("at").alias("at"), F.lit(MARK).alias("kind"), F.lit(1).alias("by")), F.struct(F.concat("at", F.array(F.lit(CLOSE))).alias("at"), F.lit(UNMARK).alias("kind"), F.lit(-1).alias("by")))
    rows = placed.select("snapshot", "root", F.explode(steps).alias("x"))
    by, zero = F.col("x.by").cast("long"), F.lit(0).cast("long")
    amounts = {"away": by if column == "away" else zero, "whole": by if column == "whole" else zero, "leads": F.when(F.col("x.by") > 0, by).otherwise(zero) if column == "whole" else zero}
    return rows.select("snapshot", "root", F.col("x.at").alias("at"), F.col("x.kind").alias("kind"), F.lit(None).cast("string").alias("path"), F.lit(False).alias("is_open"), *[v.alias(k) for k, v in amounts.items()])


def filter_listing(entries: DataFrame, groups: DataFrame, filter_in: list[str] = (), filter_out: list[str] = ()) -> DataFrame:
    """Direct members only: out of every ``filter_out`` group and, if any is given, in a ``filter_in`` group."""
    keys = ["snapshot", "kind", "full_path"]
    pick = lambda names: groups.where(F.col("group").isin(list(names))).select("snapshot", "kind", F.col("path").alias("full_path")).distinct()
    if filter_out:
        entries = entries.join(pick(filter_out), keys, "left_anti")
    return entries.join(pick(filter_in), keys, "left_semi") if filter_in else entries


def select(entries: DataFrame, dirs: DataFrame, groups: DataFrame, filter_in: list[str] = (), filter_out: list[str] = (), mode: str = "strict") -> DataFrame:
    """Files of the tree that group filters leave; ``dirs`` must be the reachable ones.

    A file goes if a directory above it, the root excepted, or itself is in a ``filter_out``
    group. With ``filter_in`` it stays only if a directory above it, the root excepted, is in
    one of those groups, or if it is itself: in 'strict' mode only where its directory is the
    root or leads to such a directory, in 'intuitive' mode anywhere. Flags are made once per
    directory: in pre-order, a directory is in the marked subtrees that are open there, and leads to the marks that
    open before it ends. Files are joined by their parent alone.
    """
    if mode not in ("strict", "intuitive"):
        raise ValueError("mode is strict or intuitive")
    dirs = kept(dirs.select("snapshot", "path", "root", "os_name"))
    files = entries.where("kind = 'f'")
    if filter_out:
        files = files.join(_named(groups, filter_out, "f", "full_path"), ["snapshot", "full_path"], "left_anti")
    zero = F.lit(0).cast("long")
    rows = bracketed(dirs, {"away": zero, "whole": zero, "leads": zero}, both=bool(filter_in) and mode == "strict", columns=["os_name"]).drop("os_name")
    for names, column in ((filter_out, "away"), (filter_in, "whole")):
        if names:
            rows = rows.unionByName(_marks(dirs, _named(groups, names, "d", "path"), column))
    seen = running(rows, ["snapshot", "root"], ["at", "kind"], {"n_away": "away", "n_whole": "whole", "n_leads": "leads"}).where("path IS NOT NULL")
    at_open = lambda c: F.max(F.when(F.col("is_open"), F.col(c)))
    begun = F.min(F.when(F.col("is_open"), F.col("n_leads")))
    # A marked directory stands before its own row, so it leads to itself as one of the marks that are open there.
    flags = seen.groupBy("snapshot", F.col("path").alias("parent"), "root").agg((at_open("n_away") == 0).alias("__kept"), (at_open("n_whole") > 0).alias("__whole"), (F.max(F.when(~F.col("is_open"), F.col("n_leads"))) > begun).alias("__leads"))
    flags = flags.where("__kept")
    if not filter_in:
        return files.join(flags.select("snapshot", "parent"), ["snapshot", "parent"], "left_semi")
    direct = F.lit(True) if mode == "intuitive" else (F.col("parent") == F.col("root")) | F.coalesce("__leads", F.lit(False)) | F.col("__whole")
    flags = flags.select("snapshot", "parent", "__whole", direct.alias("__direct")).where("__whole OR __direct")
    own = _named(groups, filter_in, "f", "full_path").withColumn("__own", F.lit(True))
    met = files.join(flags, ["snapshot", "parent"]).join(own, ["snapshot", "full_path"], "left")
    return met.where("__whole OR (__direct AND __own)").select(*entries.columns)


def filtered_totals(entries: DataFrame, dirs: DataFrame, groups: DataFrame, filter_in: list[str] = (), filter_out: list[str] = ()) -> DataFrame:
    """(snapshot, path, S, C) of what is left below each directory.

    Without ``filter_in`` the rules of ``select`` hold from that directory down. With it only
    the direct files that are members themselves count, whatever the directory is in.
    """
    if filter_in:
        files = filter_listing(entries.where("kind = 'f'"), groups, filter_in, filter_out)
        sums = files.groupBy("snapshot", F.col("parent").alias("path")).agg(F.sum("size").alias("S"), F.count("*").alias("C"))
    else:
        # A directory that is itself in a group still shows what its own subtree would hold: below each directory
        # count the rows in as many marked subtrees as itself.
        left = entries.where("kind = 'f'").join(_named(groups, filter_out, "f", "full_path"), ["snapshot", "full_path"], "left_anti")
        direct = left.groupBy("snapshot", F.col("parent").alias("path")).agg(F.sum("size").cast("long").alias("direct_size"), F.count("*").alias("n_files"))
        base = kept(dirs.select("snapshot", "path", "root", "os_name").distinct().join(direct, ["snapshot", "path"], "left"))
        rows = bracketed(base, {"direct_size": F.coalesce("direct_size", F.lit(0)), "n_files": F.coalesce("n_files", F.lit(0)), "away": F.lit(0)})
        marks = _marks(base, _named(groups, filter_out, "d", "path"), "away").drop("whole", "leads").withColumns({"direct_size": F.lit(0).cast("long"), "n_files": F.lit(0).cast("long")})
        depth = running(rows.unionByName(marks), ["snapshot", "root"], ["at", "kind"], {"n_away": "away"}).where("path IS NOT NULL OR n_files > 0").select(*rows.columns, "n_away")
        sums = sums_within(depth, ["snapshot", "root", "n_away"], {"S": "direct_size", "C": "n_files"})
    whole = dirs.select("snapshot", "path").join(sums, ["snapshot", "path"], "left")
    return whole.select("snapshot", "path", F.coalesce("S", F.lit(0)).cast("long").alias("S"), F.coalesce("C", F.lit(0)).cast("long").alias("C"))


