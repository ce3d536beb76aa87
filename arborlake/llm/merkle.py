"""A Merkle manifest of a dataset: a leaf per row, 16-ary trees per group and over the groups, and proofs.

Rows are sorted by range; per-group counts of the partitions give every leaf its place in its group, whatever the group's
size. A tile is 4,096 leaves at an aligned place. Each task reduces what it has of a tile to aligned complete subtrees; whole
tiles are done then, and the ragged nodes of tiles that a cut runs through meet by coordinate (group, tile). Upper
levels are groups of at most 16 nodes, level by level, for all groups at once; paths go down the same levels again, so
that a tile's leaves are proved from the tile and one path.

Defined results: null values are the leaf's ``-``, a null group is a group of its own and the first; within a group leaves
ascend by id (null first), those of one id (repeated rows) by digest; an empty table has no rows. Columns beside the five of
the leaf take no part. Ids have to be whole numbers, n_chars too; values are of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.llm.shared import written
from arborlake.operators.ordered import PART, new_runs, running

FANOUT = 16
#: Levels below a tile's root, and leaves of a tile.
LEVELS = 3
TILE = FANOUT**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PATH = "array<struct<left:string,right:string>>"


def leaf_of(fields: list[Column]) -> Column:
    """SHA-256 in hex of the values, each ``-`` or its UTF-8 byte count, a colon and itself."""
    coded = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in (c.cast("string") for c in fields)]
    return F.sha2(F.concat(*coded), 256)


def tampered_with(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def parent(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def reduced(nodes: dict[tuple[int, int], str], ends_at: int | None) -> dict[tuple[int, int], str]:
    """Nodes (level, place) of one tile with every complete aligned run replaced by its parent.

    ``ends_at`` is the number of the tile's leaves where it is known: then its last run is complete too.
    """
    nodes = dict(nodes)
    for level in range(LEVELS):
        runs: dict[int, list[int]] = {}
        for lv, at in nodes:
            if lv == level:
                runs.setdefault(at // FANOUT, []).append(at)
        size = None if ends_at is None else -(-ends_at // FANOUT**level)
        for run, places in runs.items():
            full = FANOUT if size is None else min(FANOUT, size - run * FANOUT)
            if len(places) == full:
                nodes[level + 1, run] = parent([nodes.pop((level, at)) for at in sorted(places)])
    return nodes


def height(leaves: int, only: bool) -> int:
    """Levels between a tile's leaves and its top: all of them, or as many as its leaves need where it is the group's only one."""
    if not only:
        return LEVELS
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FANOUT), levels + 1
    return levels


def tower(leaves: list[str], levels: int) -> list[list[str]]:
    """The nodes of a tile by level, its leaves first."""
    out = [leaves]
    for _ in range(levels):
        last = out[-1]
        out.append([parent(last[i : i + FANOUT]) for i in range(0, len(last), FANOUT)])
    return out


def _runs(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    return [*np.flatnonzero(new_runs([batch.column(k) for k in keys], None)).tolist(), batch.num_rows]


def local_subtrees(leaves: DataFrame) -> DataFrame:
    """(group, tile, level, at, hash): each task's complete aligned subtrees of the leaves (group, tile, part, at, leaf) in the order of the file."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, last = {}, None, None

        def done() -> list[tuple]:
            return [(*key, level, at, h) for (level, at), h in reduced(held, None).items()] if held else []

        for b in batches:
            if not b.num_rows:
                continue
            out, cuts = [], _runs(b, ["group", "tile", "part"])
            for a, z in zip(cuts, cuts[1:], strict=False):
                part = b.slice(a, z - a)
                now = (part.column("group")[0].as_py(), part.column("tile")[0].as_py())
                if now != key or last != part.column("part")[0].as_py():
                    out += done()
                    held, key, last = {}, now, part.column("part")[0].as_py()
                for at, leaf in zip(part.column("at").to_pylist(), part.column("leaf").to_pylist(), strict=True):
                    held[0, at] = leaf
            yield _nodes(out)
        yield _nodes(done())

    return leaves.mapInArrow(run, "group string, tile long, level int, at int, hash string")


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("group", pa.string()), ("tile", pa.int64()), ("level", pa.int32()), ("at", pa.int32()), ("hash", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])


def finish_tiles(ragged: DataFrame, sizes: DataFrame) -> DataFrame:
    """(group, tile, hash) of tiles whose nodes several tasks have, or whose last run is short; at most 4,096 nodes a tile."""
    nodes = ragged.groupBy("group", "tile").agg(F.collect_list(F.struct("level", "at", "hash")).alias("nodes"))
    met = nodes.join(sizes, nodes["group"].eqNullSafe(sizes["of"])).select("group", "tile", "nodes", "n")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tops = []
            for tile, nodes, n in zip(b.column("tile").to_pylist(), b.column("nodes").to_pylist(), b.column("n").to_pylist(), strict=True):
                size = min(TILE, n - tile * TILE)
                levels = height(size, n <= TILE)
                have = {(x["level"], x["at"]): x["hash"] for x in nodes}
                for level in range(levels):
                    runs: dict[int, list[int]] = {}
                    for lv, at in have:
                        if lv == level:
                            runs.setdefault(at // FANOUT, []).append(at)
                    for r, places in runs.items():
                        have[level + 1, r] = parent([have.pop((level, at)) for at in sorted(places)])
                tops.append(have[levels, 0])
            yield pa.RecordBatch.from_arrays([b.column("group"), b.column("tile"), pa.array(tops, pa.string())], names=["group", "tile", "hash"])

    return met.mapInArrow(run, "group string, tile long, hash string")


def climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The runs (group, at, hashes) of every level above ``nodes`` (group, at, hash, n: nodes of the group), and (group, hash) of the tops."""
    levels, tops = [], None
    while True:
        top = nodes.where("n = 1").select("group", "hash")
        tops = top if tops is None else tops.unionByName(top)
        rest = nodes.where("n > 1")
        if not rest.take(1):
            return levels, tops
        runs = rest.groupBy("group", "n", F.floor(F.col("at") / FANOUT).alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("x"))
        runs = written(runs.select("group", "n", "at", F.col("x.hash").alias("hashes")))
        levels.append(runs)
        nodes = runs.select("group", "at", F.sha2(F.array_join("hashes", ""), 256).alias("hash"), F.ceil(F.col("n") / FANOUT).alias("n"))


def descended(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(group, at, path) of the lowest nodes: their siblings to the left and right, level by level upwards.

    ``tops`` has (group, path), the path above each group's top.
    """
    above = tops.select("group", F.lit(0).cast("long").alias("at"), "path")
    for runs in reversed(levels):
        p = above.select(F.col("group").alias("of"), F.col("at").alias("up"), "path")
        met = runs.join(p, runs["group"].eqNullSafe(p["of"]) & (runs["at"] == p["up"]))
        child = met.select("group", F.col("at").alias("up"), "path", "hashes", F.posexplode("hashes").alias("i", "h"))
        near = F.struct(F.array_join(F.slice("hashes", F.lit(1), F.col("i")), "").alias("left"), F.array_join(F.slice("hashes", F.col("i") + 2, F.lit(FANOUT)), "").alias("right"))
        down = child.select("group", (F.col("up") * FANOUT + F.col("i")).alias("at"), F.concat(F.array(near), F.col("path")).alias("path"))
        # Tops of groups that have no run at this level yet stay as they are.
        have = runs.select(F.col("group").alias("of")).distinct()
        stay = above.join(have, above["group"].eqNullSafe(have["of"]), "left_anti").select("group", "at", "path")
        above = written(down.unionByName(stay))
    return above


def proofs(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified; see ``tampered_with`` for what is folded."""
    fields = [F.col(c) for c in FIELDS]
    changed = F.when(tampered_with(F.col("doc_id")), leaf_of([*fields[:-1], F.translate("text", UPPER, UPPER.lower())]))
    leaves = docs.select(F.col("source").cast("string").alias("group"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(fields).alias("leaf"), changed.alias("changed"))
    # Written first: a sort by range reads its input twice, and would make the digests twice.
    placed = running(written(leaves), ["group"], ["doc_id", "leaf"], rank="rank")
    placed = placed.select("group", "doc_id", "leaf", F.coalesce("changed", "leaf").alias("folded"), F.floor(F.col("rank") / TILE).alias("tile"), (F.col("rank") % TILE).cast("int").alias("at"), F.col(PART).alias("part"))
    sizes = written(placed.groupBy(F.col("group").alias("of")).agg(F.count("*").alias("n")))
    nodes = written(local_subtrees(placed.select("group", "tile", "part", "at", "leaf")))
    whole = nodes.where(F.col("level") == LEVELS).select("group", "tile", "hash")
    tiles = whole.unionByName(finish_tiles(nodes.where(F.col("level") < LEVELS), sizes))
    counted = tiles.join(sizes, tiles["group"].eqNullSafe(sizes["of"])).select("group", F.col("tile").alias("at"), "hash", F.ceil(F.col("n") / TILE).alias("n"))
    levels, subroots = climbed(written(counted))
    # The groups' own tree: their places by the same ranks, one group of all.
    subroots = running(written(subroots), [], ["group"], rank="place").select("group", F.col("hash").alias("subroot"), "place")
    n_groups = subroots.agg(F.count("*")).first()[0]
    top = subroots.select(F.lit(None).cast("string").alias("group"), F.col("place").alias("at"), F.col("subroot").alias("hash"), F.lit(n_groups).cast("long").alias("n"))
    upper, root = climbed(top)
    root_row = root.select("hash").take(1)
    root_hash = root_row[0].hash if root_row else None
    above = descended(upper, root.select("group", F.array().cast(_PATH).alias("path")))
    tops = written(subroots.join(above.select(F.col("at").alias("place"), "path"), "place").select("group", "subroot", "path"))
    paths = descended(levels, tops.select("group", "path"))
    p = paths.select(F.col("group").alias("of"), F.col("at").alias("tile_of"), F.col("path"))
    s = tops.select(F.col("group").alias("within"), "subroot")
    one = p.join(s, p["of"].eqNullSafe(s["within"])).join(sizes.withColumnRenamed("of", "counted"), F.col("of").eqNullSafe(F.col("counted"))).select("of", "tile_of", "path", "subroot", "n")
    return _proved(placed, one, root_hash)


def _proved(placed: DataFrame, tiles: DataFrame, root: str | None) -> DataFrame:
    """The leaves with their tile's path; a task holds one tile at a time."""
    none = lambda kind: F.lit(None).cast(kind)
    head = tiles.select(F.col("of").alias("group"), F.col("tile_of").alias("tile"), F.lit(-1).alias("at"), none("long").alias("doc_id"), none("string").alias("leaf"), none("string").alias("folded"), "path", "subroot", "n")
    body = placed.select("group", "tile", "at", "doc_id", "leaf", "folded", none(_PATH).alias("path"), none("string").alias("subroot"), none("long").alias("n"))
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def prove(rows: list[tuple]) -> list[tuple]:
        (_, _, _, path, subroot, n), leaves = rows[0], rows[1:]
        levels = tower([r[1] for r in leaves], height(len(leaves), n <= TILE))[:-1]
        above = "".join(x["left"] + x["right"] for x in path)
        out = []
        for i, (doc_id, leaf, folded, *_) in enumerate(leaves):
            near, node, at = [], folded, i
            for nodes in levels:
                a = at - at % FANOUT
                left, right = "".join(nodes[a:at]), "".join(nodes[at + 1 : a + FANOUT])
                near.append(left + right)
                node, at = sha(left + node + right), at // FANOUT
            for x in path:
                node = sha(x["left"] + node + x["right"])
            out.append((doc_id, leaf, subroot, root, sha("".join(near) + above), node, node == root))
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "leaf", "folded", "path", "subroot", "n"]
        held: list[tuple] = []
        for b in batches:
            rows, out = list(zip(*(b.column(c).to_pylist() for c in names), strict=True)), []
            for at, row in zip(b.column("at").to_pylist(), rows, strict=True):
                if at < 0 and held:
                    out += prove(held)
                    held = []
                held.append(row)
            yield result(out)
        yield result(prove(held) if held else [])

    def result(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [("doc_id", pa.int64()), *[(n, pa.string()) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    dealt = head.unionByName(body).repartition("group", "tile").sortWithinPartitions("group", "tile", "at")
    return dealt.mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
