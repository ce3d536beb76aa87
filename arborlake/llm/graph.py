"""Connected components by alternating stars, with contraction inside partitions first."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.shared import written


#: Edges that one task contracts at most, instead of further rounds over all tasks.
FEW = 100_000


class Forest:
    """Union-find; the root of a tree is its smallest member."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _contracted(edges: DataFrame) -> DataFrame:
    """Each partition's edges as stars around the least node; a task holds the nodes of its own partition only."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, kind = Forest(), None
        for b in batches:
            kind = b.schema
            for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                forest.union(a, c)
        pairs = [(x, forest.find(x)) for x in list(forest.parent)]
        pairs = [(x, r) for x, r in pairs if x != r]
        for i in range(0, len(pairs), 50_000):
            part = pairs[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], kind.field(0).type), pa.array([r for _, r in part], kind.field(1).type)], names=["u", "v"])

    return edges.mapInArrow(run, edges.schema)


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(u, v): every node that is not the least of its component, and that least node.

    Large-star and small-star rounds until nothing changes; each round is written to the
    shared folder. A node's neighbours are never gathered: its least one is aggregated
    with map-side minima and joined back. Once ``FEW`` edges or less are left, one task contracts them.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u != v")
    e = written(_contracted(e).distinct())
    before = None
    while True:
        told = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if told == before or not told[0]:
            return e
        if told[0] <= FEW:
            return written(_contracted(e.repartition(1)))
        before = told
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = written(small.distinct())
