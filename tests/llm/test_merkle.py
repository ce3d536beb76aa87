"""The Merkle manifest against a plain tree, group by group and leaf by leaf."""

import hashlib
import random
import zlib

import pytest

from arborlake.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tile string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def plain(rows):
    """The result by recursion over lists."""

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            n = levels[-1]
            levels.append([h(*n[i : i + 16]) for i in range(0, len(n), 16)])
        return levels

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in groups:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r[:5])))
    trees = {s: tree([leaf(*r[:5]) for r in groups[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for g, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if r[4] is not None else None
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node, near = leaf(*r[:4], lower) if bad else trees[s][0][i], []
            for levels, at in ((trees[s], i), (top, g)):
                for level in levels[:-1]:
                    a = at - at % 16
                    left, right = level[a:at], level[at + 1 : a + 16]
                    near += left + right
                    node, at = h(*left, node, *right), at // 16
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], h(*near), node, node == top[-1][0]))
    return out


@pytest.mark.parametrize("hot", [0, 4095, 4096, 4097, 9500])
def test_proofs_match_plain_tree(spark, hot):
    rng = random.Random(hot)
    text = lambda: rng.choice([None, "", "Ünï " * rng.randrange(4), f"Text {rng.random()}", "lower"])
    sizes = [1, 2, 15, 16, 17, 33, 255, 256, 257, *[3] * 20]
    rows = [(i * 7 + k, None if k == 3 else f"s{k}", rng.choice(["en", None]), rng.choice([None, i]), text(), "x") for k, n in enumerate(sizes) for i in range(n)]
    rows += [(i, "é", "de", None, text(), "x") for i in range(hot)]
    rows += [(5, "s1", "en", 1, "same", "y")] * 3 + [(None, "s2", None, None, None, None)] * 2 + [(8, "s5", "en", 1, "a" * 300_000 + "Z", "y")]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in merkle.proofs(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


def test_proofs_of_one_and_none(spark):
    assert merkle.proofs(spark.createDataFrame([], SCHEMA)).collect() == []
    row = (4, None, None, None, None, None)
    assert [tuple(r) for r in merkle.proofs(spark.createDataFrame([row], SCHEMA)).collect()] == plain([row])
