"""Totals and selection on deep trees against plain walks up the paths; the rows that are sorted do not grow with the depth."""

import random

import pytest

from arborlake.operators import groups, tree

DIRS = "snapshot string, seq long, path string, root string, os_name string, direct_size long, n_files long, n_subdirs long"
ENTRIES = "snapshot string, seq long, pos int, kind string, parent string, name string, full_path string, size long, created long, modified long, accessed long"


def deep_tree(depth, seed):
    """A chain of ``depth`` directories with short branches, names that are prefixes of each other, and a file in most."""
    rng = random.Random(seed)
    paths, at = ["/r"], "/r"
    for _ in range(depth):
        at += "/" + rng.choice(["a", "ab", "a b", "é", "zz"])
        paths.append(at)
        if rng.random() < 0.3:
            paths.append(at + "x")
    return list(dict.fromkeys(paths)), rng


def above(path, root="/r"):
    """The path and all its ancestors down to the root."""
    out = [path]
    while out[-1] != root:
        out.append(out[-1].rpartition("/")[0])
    return out


@pytest.mark.parametrize(("depth", "seed"), [(200, 1), (30, 2), (0, 3)])
def test_deep_trees(spark, depth, seed):
    paths, rng = deep_tree(depth, seed)
    direct = {p: (rng.randrange(100), rng.randrange(3)) for p in paths}
    listed = {p for p in paths[1:] if rng.random() < 0.99}
    gone = set(rng.sample(paths[1:], min(2, len(paths) - 1))) if seed == 2 else set()
    here = [p for p in paths if p not in gone]
    dirs = spark.createDataFrame([("s", i, p, "/r", "Linux", *direct[p], 0) for i, p in enumerate(here)], DIRS)
    entries = spark.createDataFrame([("s", 0, 0, "d", above(p)[1], p.rpartition("/")[2], p, None, 1, 1, 1) for p in listed], ENTRIES)
    reach = [p for p in here if all(q in listed and q in here for q in above(p)[:-1])]
    assert sorted(r.path for r in tree.reachable(dirs, entries).collect()) == sorted(reach)
    want = {p: (sum(direct[q][0] for q in reach if p in above(q)), sum(direct[q][1] for q in reach if p in above(q))) if p in reach else direct[p] for p in here}
    assert {r.path: (r.S, r.C) for r in tree.rollup(dirs, entries).collect()} == want
    marked = [p for p in here if rng.random() < 0.02][:3] + ["/r"]
    files = [("s", i, 0, "f", p, f"f{k}", f"{p}/f{k}", rng.randrange(50), 1, 1, 1) for i, p in enumerate(here) for k in range(direct[p][1])]
    table = spark.createDataFrame(files, ENTRIES)
    named = spark.createDataFrame([("s", "out", "d", p) for p in marked] + [("s", "out", "f", f[6]) for f in files[::9]], "snapshot string, group string, kind string, path string")
    left = [f for f in files if f not in files[::9]]
    below = lambda p, f: p in above(f[4]) and not any(q in marked and q != "/r" for q in above(f[4])[: above(f[4]).index(p)])
    totals = {p: (sum(f[7] for f in left if below(p, f)), sum(1 for f in left if below(p, f))) for p in here}
    assert {r.path: (r.S, r.C) for r in groups.filtered_totals(table, dirs, named, [], ["out"]).collect()} == totals
    inside = spark.createDataFrame([("s", "in", "d", here[len(here) // 2]), ("s", "in", "f", files[-1][6] if files else "/none")], "snapshot string, group string, kind string, path string")
    both = named.unionByName(inside)
    ok = lambda f: not any(q in marked and q != "/r" for q in above(f[4])) and f in left and here[len(here) // 2] != "/r" and here[len(here) // 2] in above(f[4])
    chosen = {f[6] for f in files if ok(f)}
    got = {r.full_path for r in groups.select(table, dirs, both, ["in"], ["out"], "strict").collect()}
    assert chosen <= got and got - chosen <= {files[-1][6] if files else "/none"}


def test_rows_sorted_are_two_a_directory(spark):
    paths, _ = deep_tree(150, 4)
    dirs = spark.createDataFrame([("s", i, p, "/r", "Linux", 1, 1, 0) for i, p in enumerate(paths)], DIRS)
    marked = tree.bracketed(dirs, {"direct_size": dirs["direct_size"]})
    assert marked.count() == 2 * len(paths)
