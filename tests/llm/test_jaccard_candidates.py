"""Which sets the Jaccard join takes for candidates: all that link, and unlike ones not because they share shingles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.llm import graph, jaccard_join
from arborlake.llm.repeated_spans import text_key

K, PERCENT = 2, 90


def texts(rng, unlike, families=()):
    """Texts over few words, so that their shingles are shared, and families of near copies of one text."""
    make = lambda: [f"w{rng.randrange(60)}" for _ in range(120)]
    out = [make() for _ in range(unlike)]
    for size in families:
        base = make()
        for _ in range(size):
            own = list(base)
            own[rng.randrange(120)] = "other"
            out.append(own)
    return list(dict.fromkeys(map(" ".join, out)))


def shingles(text):
    w = text.split()
    return set(zip(*(w[i:] for i in range(K)), strict=False))


def linked(all_texts):
    """The components of brute force that have several texts."""
    forest, sets = graph.Forest(), [shingles(t) for t in all_texts]
    for i, a in enumerate(sets):
        forest.find(i)
        for j in range(i):
            common = len(a & sets[j])
            if 100 * common >= PERCENT * (len(a) + len(sets[j]) - common):
                forest.union(i, j)
    parts = {}
    for i in range(len(sets)):
        parts.setdefault(forest.find(i), set()).add(i)
    return {frozenset(p) for p in parts.values() if len(p) > 1}


def candidate_clusters(spark, all_texts):
    """The components of the candidates where the sketch has one counter, so that it tells no shingle from another."""
    docs = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string").withColumn("tkey", text_key(F.col("text")))
    sketch = spark.sparkContext.broadcast(np.ones(1, dtype=np.uint16))
    nodes = jaccard_join.written(jaccard_join._signed(docs, K, PERCENT, sketch))
    of = {r.u: r.doc_id for r in nodes.select("doc_id", F.xxhash64("node").alias("u")).collect()}
    parts = {}
    for r in graph.components(jaccard_join._candidates(nodes, PERCENT)).collect():
        parts.setdefault(of[r.v], {of[r.v]}).add(of[r.u])
    return {frozenset(p) for p in parts.values()}


@pytest.mark.parametrize("unlike", [200, 500])
def test_unlike_sets_that_share_shingles_form_no_cluster(spark, unlike):
    every = texts(random.Random(unlike), unlike, (2, 3, 80))
    found, want = candidate_clusters(spark, every), linked(every)
    assert len(want) == 3 and max(map(len, want)) > 50
    assert all(any(w <= f for f in found) for w in want)
    assert sum(map(len, found)) <= sum(map(len, want)) + 4


@pytest.mark.parametrize("told,compared", [(64, 4096), (1, 4096), (1, 10), (0, 0)])
def test_candidates_hold_all_links_however_many_share_a_shingle(spark, told, compared, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TOLD", told)
    monkeypatch.setattr(jaccard_join, "COMPARED", compared)
    every = texts(random.Random(7), 60, (2, 5, 40))
    found, want = candidate_clusters(spark, every), linked(every)
    assert len(want) == 3 and all(any(w <= f for f in found) for w in want)
    got = jaccard_join.jaccard_components(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string"), K, PERCENT, width=1 << 16).collect()
    parts = {}
    for r in got:
        parts.setdefault(r.component_id, set()).add(r.doc_id)
    assert {frozenset(p) for p in parts.values() if len(p) > 1} == want


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_bitmaps_differ_in_no_more_bits_than_sets_in_shingles(percent):
    rng = np.random.default_rng(percent)
    for _ in range(200):
        base = np.unique(rng.integers(1, 1 << 63, rng.integers(2, 600), dtype=np.uint64))
        gone, more = rng.integers(0, len(base)), rng.integers(0, len(base))
        other = np.unique(np.r_[base[gone:], rng.integers(1, 1 << 63, more, dtype=np.uint64)])
        a, b = (np.frombuffer(jaccard_join.parities(s, percent), dtype="<u8")[None] for s in (base, other))
        apart, told = len(np.setxor1d(base, other)), int(jaccard_join.bits_apart(a, b)[0])
        assert told <= apart and told % 2 == apart % 2
        common = len(np.intersect1d(base, other))
        if 100 * common >= percent * (len(base) + len(other) - common):
            assert apart <= jaccard_join.most_unlike(len(base), len(other), percent)


def test_texts_that_no_task_asks_for_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3000)], "doc_id long, text string").withColumn("tkey", text_key(F.col("text"))).select("tkey", "text")
    asked = docs.where("text LIKE '%7'")
    got = {r.text for r in jaccard_join._asked(docs, asked.unionByName(asked).select("tkey")).collect()}
    assert {f"text {i}" for i in range(7, 3000, 10)} <= got and len(got) <= 305
    assert jaccard_join._asked(docs, asked.limit(0)).count() == 0
