"""The trie against plain prefixes of every rebuilt conversation."""

import hashlib
import random
import re
import zlib

import pytest

from arborlake.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string"


def plain(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    original = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c in original:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = original.get(c - c % 20, [])[:h] + original[c][h:]
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for seq, members in nodes.items():
        below = [s for s in nodes if s[: len(seq)] == seq]
        words = lambda s: len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        children = [s for s in below if len(s) == len(seq) + 1]
        leaves = [s for s in below if not any(t != s and t[: len(s)] == s for t in below)]
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(seq))
        out.append((min(members), len(seq), min(nodes[seq[:-1]]) if seq else None, len(members), len(children), len(leaves), sum((len(nodes[s]) - 1) * words(s) for s in below), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def table(seed):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "a b", "a\tb  c", "é ü", "Hello\n there world", " "])
    rows = []
    for c in [*range(0, 90), 121, 122, 125, 140, 141]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), text(), "x"))
    rows += [(500 + i, t, "user", f"same {t % 3}", "x") for i in range(6) for t in range(12)]
    rows += [(7, 0, "user", "again", "x"), (7, 0, "user", "again", "x"), (8, None, "user", "first", "x"), (None, 0, "user", "no id", "x"), (9, 1, "user", "w " * 200_000, "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("first", "small", "hot"), [(4, 20_000, 10_000), (0, 20_000, 10_000), (0, 12, 3), (99, 0, 3)])
def test_trie_matches_plain_prefixes(spark, first, small, hot):
    rows = table(small + first)
    out = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(3), first=first, small=small, hot=hot)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(plain(rows), key=repr)


def test_trie_of_none(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie.trie(spark.createDataFrame([(None, 0, "user", "x", None)], SCHEMA)).collect() == []


def test_ends_digests_join_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LIST_BYTES", 20)
    ids = [i * 3 % 1000 for i in range(1000)]
    got = prefix_trie.ends_digests(spark.createDataFrame([(i % 3, i % 2, i) for i in ids], "depth long, node long, conv_id long").repartition(4)).collect()
    want = {(d, n): hashlib.sha256(",".join(str(i) for i in sorted(ids) if i % 2 == n and i % 3 == d).encode()).hexdigest() for d in (0, 1, 2) for n in (0, 1)}
    assert {(r.depth, r.node): r.sha for r in got} == want
