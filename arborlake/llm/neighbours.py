"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

The trees' first planes are fitted on a bounded sample; every vector is put into one leaf
of each tree. Leaves of more than ``most`` rows are split further in rounds: a bounded draw of
each one's rows gives it a subtree, until all are small or hold one repeated vector. A
query walks all trees through one shared priority queue, nearest planes first, until it
has its own leaf of every tree, ``least`` leaves, and leaves of a certain share of the rows; the rows
found there are ranked by exact cosine in double precision.

That share is measured, as it depends on the vectors: ``PROBES`` query rows are searched by
brute force, and the share is the least that reaches ``TARGET`` of their true neighbours. So vectors
without any structure are found as well, from large shares. A tree has some ``LEAVES`` leaves at most, which
bounds what is broadcast.

Leaves with many rows (a vector that a third of the table repeats) are dealt out in parts
of ``PART`` rows and each part keeps its best ``k``, so no task holds a whole leaf and
nothing is dropped that could rank.

Defined results: vectors that are null, zero, or hold a null or non-finite number take no
part, nor do rows with a null vec_id or with another length than most vectors; of rows
with one vec_id the smallest vector counts; ties go to the smaller vec_id; a query with
fewer than ``k`` found is searched exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.llm.shared import sorted_groups, written

SAMPLE, TREES, LEAF, PART = 20_000, 5, 400, 4_096
#: Rows above which a leaf is split further, rows drawn for that, and leaves that a query visits at least.
MOST, DRAW, LEAST = 1_000, 256, 60
#: Queries that the share is measured with, the share of their neighbours to reach, and leaves of a tree.
PROBES, TARGET, LEAVES = 200, 0.96, 1 << 14
#: Query rows of one broadcast block of the exact search, and of one product with a part's vectors.
BLOCK, PRODUCT = 20_000, 256
#: Two cosines of a fast product may differ by less than this from those summed one by one.
SLACK = 1e-9


@dataclass
class Tree:
    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray  # nodes x 2; a child below 0 is leaf -1 - child
    share: np.ndarray  # of the rows in each leaf

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        at = np.zeros(len(unit), dtype=np.int64) if len(self.children) else np.full(len(unit), -1, dtype=np.int64)
        rows = np.flatnonzero(at >= 0)
        while len(rows):
            node = at[rows]
            right = np.einsum("ij,ij->i", unit[rows], self.normals[node]) > self.offsets[node]
            at[rows] = self.children[node, right.astype(np.int64)]
            rows = rows[at[rows] >= 0]
        return -1 - at


def grow(unit: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """Splits between two random members until a node has ``leaf`` rows or cannot be split."""
    normals, offsets, children, share = [], [], [], []

    def node(rows: np.ndarray) -> int:
        if len(rows) > leaf:
            for _ in range(8):
                a, b = unit[rng.choice(rows, 2, replace=False)]
                normal = a - b
                if not normal.any():
                    continue
                offset = float(normal @ (a + b) / 2)
                right = np.einsum("ij,j->i", unit[rows], normal) > offset
                if right.any() and not right.all():
                    me = len(normals)
                    normals.append(normal)
                    offsets.append(offset)
                    children.append([0, 0])
                    children[me] = [node(rows[~right]), node(rows[right])]
                    return me
        share.append(len(rows) / max(len(unit), 1))
        return -len(share)

    node(np.arange(len(unit)))
    d = unit.shape[1]
    return Tree(np.array(normals).reshape(-1, d), np.array(offsets), np.array(children, dtype=np.int64).reshape(-1, 2), np.array(share))


def grafted(tree: Tree, subtrees: dict[int, Tree]) -> Tree:
    """The tree with subtrees in the place of leaves; each one's first leaf takes the old number."""
    normals, offsets, children, leaves = [tree.normals], [tree.offsets], tree.children.copy(), len(tree.share)
    nodes = len(children)
    parts = [children]
    for leaf, sub in subtrees.items():
        numbers = np.r_[leaf, np.arange(leaves, leaves + len(sub.share) - 1)]
        leaves += len(sub.share) - 1
        own = sub.children
        parts.append(np.where(own < 0, -1 - numbers[np.where(own < 0, -1 - own, 0)], own + nodes))
        children[children == -1 - leaf] = nodes
        normals.append(sub.normals)
        offsets.append(sub.offsets)
        nodes += len(own)
    return Tree(np.concatenate(normals), np.concatenate(offsets), np.concatenate(parts), np.zeros(leaves))


class Queue:
    """The shared priority queue of some queries over all trees."""

    def __init__(self, forest: list[Tree], unit: np.ndarray):
        self.forest = forest
        self.margins = [(unit @ t.normals.T - t.offsets) / np.sqrt((t.normals**2).sum(axis=1)) if len(t.children) else None for t in forest]

    def leaves(self, q: int) -> Iterator[tuple[int, int]]:
        """The (tree, leaf) pairs of query number ``q``, nearest first."""
        queue = [(-np.inf, i, 0 if len(t.children) else -1) for i, t in enumerate(self.forest)]
        while queue:
            near, i, at = heapq.heappop(queue)
            if at < 0:
                yield i, -1 - at
                continue
            m = float(self.margins[i][q, at])
            low, high = self.forest[i].children[at]
            heapq.heappush(queue, (max(near, m), i, int(low)))
            heapq.heappush(queue, (max(near, -m), i, int(high)))


def visited(forest: list[Tree], unit: np.ndarray, wanted: float, least: int = LEAST) -> list[list[tuple[int, int]]]:
    """For each query the (tree, leaf) pairs that the shared queue reaches, until they are ``least`` and hold ``wanted`` of the rows,
    and those of its own leaves that it has not reached by then.
    """
    home, queue, out = [t.leaves(unit) for t in forest], Queue(forest, unit), []
    for q in range(len(unit)):
        found, total = [], 0.0
        for i, leaf in queue.leaves(q):
            found.append((i, leaf))
            total += forest[i].share[leaf]
            if total >= wanted and len(found) >= least:
                break
        reached = set(found)
        out.append(found + [x for i in range(len(forest)) if (x := (i, int(home[i][q]))) not in reached])
    return out


def shares_needed(forest: list[Tree], unit: np.ndarray, near: np.ndarray) -> list[float]:
    """The share of the rows in the leaves that a query visits until it has met each vector of ``near``."""
    waiting: dict[tuple[int, int], list[int]] = {}
    for i, t in enumerate(forest):
        for n, leaf in enumerate(t.leaves(near).tolist()):
            waiting.setdefault((i, leaf), []).append(n)
    needed, total = {}, 0.0
    for i, leaf in Queue(forest, unit[None]).leaves(0):
        total += forest[i].share[leaf]
        for n in waiting.get((i, leaf), ()):
            needed.setdefault(n, total)
        if len(needed) == len(near):
            break
    return list(needed.values())


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, d)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v as array<float> if they are, else array<double>) of the rows that take part, and their length."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = F.col("embedding").cast(kind if kind == "array<float>" else "array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(sound, F.lit(False)))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = most[0].d if most else 1
    return rows.where(F.size("v") == d).groupBy("vec_id").agg(F.min("v").alias("v")), d


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(ids))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One row's products are summed in the same order whatever stands beside it, so equal vectors tie exactly."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return np.einsum("ij,j->i", x, q) / (norm * np.sqrt(np.einsum("i,i->", q, q)))


def _kind(rows: DataFrame) -> str:
    return rows.schema["v"].dataType.simpleString()


_FOUND = "query_id long, vec_id long, score double"


def _ranked(q_ids, q, ids, x, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each query's best k. A fast product leaves those that could be among them, and their cosines are summed exactly."""
    unit, wide = _unit(x), np.asarray(q_ids)
    for a in range(0, len(wide), PRODUCT):
        near = _unit(q[a : a + PRODUCT]) @ unit.T
        near[wide[a : a + PRODUCT, None] == ids[None]] = -np.inf
        edge = np.partition(near, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(near), -2.0)
        for i, row in enumerate(near):
            at = np.flatnonzero(row >= max(edge[i], -2.0) - SLACK)
            score = _cosines(q[a + i], x[at])
            best = _best(ids[at], score, k)
            yield q_ids[a + i], ids[at][best], score[best]


def _batch(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    n = [len(r[1]) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat([r[0] for r in rows], n).astype(np.int64)), pa.array(np.concatenate([r[1] for r in rows] or [np.zeros(0, np.int64)])), pa.array(np.concatenate([r[2] for r in rows] or [np.zeros(0)]))], names=["query_id", "vec_id", "score"])


def _top(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(queries: DataFrame) -> Iterator[list[tuple[int, list[float]]]]:
    held = []
    for r in queries.toLocalIterator():
        held.append((r.vec_id, r.v))
        if len(held) == BLOCK:
            yield held
            held = []
    if held:
        yield held


def exact(rows: DataFrame, queries: DataFrame, d: int, k: int) -> DataFrame:
    """The k nearest of ``queries`` among ``rows`` by brute force, in blocks of queries; every task keeps its best k."""
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for block in _blocks(queries):
        shared = rows.sparkSession.sparkContext.broadcast((np.array([i for i, _ in block], dtype=np.int64), np.array([v for _, v in block], dtype=np.float64)))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, q = shared.value
            for b in batches:
                if b.num_rows:
                    ids, x = b.column("vec_id").to_numpy(), _matrix(b.column("v"), d)
                    yield _batch(list(_ranked(q_ids, q, ids, x, k)))

        out = out.unionByName(_top(rows.mapInArrow(run, _FOUND), k))
    return out


def _placed(rows: DataFrame, shared, d: int) -> DataFrame:
    """Each row once for every tree, with its leaf."""

    def to_leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = _unit(_matrix(b.column("v"), d))
                for i, t in enumerate(shared.value):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), i, dtype=np.int32)), pa.array(t.leaves(u).astype(np.int32)), b.column("vec_id"), b.column("v")], names=["tree", "leaf", "vec_id", "v"])

    return rows.mapInArrow(to_leaves, f"tree int, leaf int, vec_id long, v {_kind(rows)}")


def _refined(rows: DataFrame, forest: list[Tree], d: int, most: int, seed: int) -> tuple[list[Tree], dict[tuple[int, int], int]]:
    """The forest with leaves of more than ``most`` rows split, and the rows of each leaf.

    A draw of one distinct vector ends the splitting of its leaf.
    """
    spark, closed = rows.sparkSession, set()
    while True:
        placed = _placed(rows, spark.sparkContext.broadcast(forest), d)
        counts = {(r.tree, r.leaf): r["count"] for r in placed.groupBy("tree", "leaf").count().toLocalIterator()}
        large = {k: n for k, n in counts.items() if n > most and k not in closed}
        if not large:
            break
        sizes = spark.createDataFrame([(t, f, n) for (t, f), n in large.items()], "tree int, leaf int, n long")
        chance = F.pmod(F.xxhash64("vec_id", "tree", "leaf"), F.lit(1 << 30)) < F.lit(DRAW * (1 << 30)) / F.col("n")
        drawn = placed.join(F.broadcast(sizes), ["tree", "leaf"]).where(chance)

        def split(group: pa.Table) -> pa.Table:
            tree, leaf, n = (group.column(c)[0].as_py() for c in ("tree", "leaf", "n"))
            unit = np.unique(_unit(_matrix(group.column("v").combine_chunks(), d)), axis=0)
            size = min(max(8, most // 2 * len(unit) // n), max(len(unit) - 1, 1))
            sub = grow(unit, size, np.random.default_rng([seed, tree, leaf]))
            return pa.table({"tree": pa.array([tree], pa.int32()), "leaf": pa.array([leaf], pa.int32()), "normals": pa.array([sub.normals.tobytes()]), "offsets": pa.array([sub.offsets.tobytes()]), "children": pa.array([sub.children.tobytes()])})

        subtrees: list[dict[int, Tree]] = [{} for _ in forest]
        for r in drawn.groupBy("tree", "leaf").applyInArrow(split, "tree int, leaf int, normals binary, offsets binary, children binary").toLocalIterator():
            children = np.frombuffer(r.children, dtype=np.int64).reshape(-1, 2)
            if len(children):
                subtrees[r.tree][r.leaf] = Tree(np.frombuffer(r.normals).reshape(-1, d), np.frombuffer(r.offsets), children, np.zeros(len(children) + 1))
        closed |= {(t, f) for t, f in large if f not in subtrees[t]}
        forest = [grafted(t, dict(sorted(sub.items()))) if sub else t for t, sub in zip(forest, subtrees, strict=True)]
    total = max(sum(counts.values()) // max(len(forest), 1), 1)
    for i, t in enumerate(forest):
        t.share = np.array([counts.get((i, leaf), 0) / total for leaf in range(len(t.share))])
    return forest, counts


def _share(rows: DataFrame, queries: DataFrame, forest: list[Tree], d: int, k: int, probes: int, target: float) -> float:
    """The share of the rows that a query has to visit, so that ``target`` of the true neighbours of ``probes`` queries are found."""
    drawn = written(queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(probes))
    truth = exact(rows, drawn, d, k).select("query_id", "vec_id").join(rows, "vec_id")
    near = truth.groupBy("query_id").agg(F.flatten(F.collect_list("v")).alias("near"))  # k vectors
    both = drawn.join(near, F.col("vec_id") == F.col("query_id")).select("v", "near").repartition(max(1, probes // 8))
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u, flat = _unit(_matrix(b.column("v"), d)), _matrix(b.column("near"), d)
                of = np.repeat(np.arange(b.num_rows), b.column("near").value_lengths().to_numpy(zero_copy_only=False) // d)
                needed = [x for i in range(len(u)) for x in shares_needed(shared.value, u[i], _unit(flat[of == i]))]
                yield pa.RecordBatch.from_arrays([pa.array(needed, pa.float64())], names=["needed"])

    needed = [r.needed for r in both.mapInArrow(measure, "needed double").collect()]
    shared.destroy()
    return float(np.quantile(needed, target, method="higher")) if needed else 1.0


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, search: int | None = None, seed: int = 11, most: int = MOST, least: int = LEAST, probes: int = PROBES, target: float = TARGET) -> DataFrame:
    """Per query row: its ``k`` nearest found as (query_id, rank, vec_id, score).

    ``search`` fixes the rows that a query visits, instead of the measured share.
    """
    spark = vectors.sparkSession
    rows, d = usable(vectors)
    rows = written(rows)
    total = rows.count()
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    unit = _unit(_matrix(drawn.column("v").combine_chunks(), d)) if drawn.num_rows else np.zeros((0, d))
    leaf, most = max(leaf, -(-total // LEAVES)), max(most, -(-2 * total // LEAVES))
    in_leaf = max(8, leaf * len(unit) // max(total, 1))
    forest = [grow(unit, in_leaf, np.random.default_rng(seed + i)) for i in range(trees)]
    forest, counts = _refined(rows, forest, d, most, seed)
    queries = rows.where(is_query)
    share = search / max(total, 1) if search else _share(rows, queries, forest, d, k, probes, target)
    shared = spark.sparkContext.broadcast(forest)
    placed = _placed(rows, shared, d)
    large = {k: -(-n // PART) for k, n in counts.items() if n > PART}
    parts_of = spark.sparkContext.broadcast(large)

    def to_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = [i % parts_of.value.get((t, f), 1) for t, f, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            key = [f"{t}.{f}.{p}" for t, f, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), part, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array([False] * len(key)), b.column(2), b.column(3)], names=["part", "query", "vec_id", "v"])

    def asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            u = _unit(_matrix(b.column("v"), d))
            at, keys = [], []
            for i, leaves in enumerate(visited(shared.value, u, share, least)):
                own = [f"{t}.{f}.{p}" for t, f in leaves for p in range(parts_of.value.get((t, f), 1))]
                keys += own
                at += [i] * len(own)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([True] * len(keys)), b.column("vec_id").take(take), b.column("v").take(take)], names=["part", "query", "vec_id", "v"])

    shape = f"part string, query boolean, vec_id long, v {_kind(rows)}"
    both = placed.mapInArrow(to_parts, shape).unionByName(queries.mapInArrow(asked, shape))

    def rerank(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in sorted_groups(batches, "part"):
            asks = group.column("query").to_numpy().astype(bool)
            if not asks.any() or asks.all():
                continue
            ids = group.column("vec_id").to_numpy()
            x = _matrix(group.column("v").combine_chunks(), d)
            yield _batch(list(_ranked(ids[asks], x[asks], ids[~asks], x[~asks], k)))

    found = both.repartition("part").sortWithinPartitions("part").mapInArrow(rerank, _FOUND)
    out = written(_top(found, k))
    full = out.groupBy("query_id").count().where(F.col("count") >= min(k, total - 1))
    short = queries.join(full, F.col("vec_id") == F.col("query_id"), "left_anti")
    if total > 1 and short.limit(1).count():
        again = exact(rows, short, d, k)
        out = out.join(short.select("vec_id"), out.query_id == short.vec_id, "left_anti").unionByName(again)
    return out
