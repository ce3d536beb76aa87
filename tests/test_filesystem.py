"""The walk in rounds against os.walk, on wide, deep and broad trees; prefixes and overlaps against brute force."""

import os
import random

import pytest

from arborlake.operators import content
from arborlake.sources import filesystem


def plain(root):
    out = {}
    for at, dirs, files in os.walk(root):
        out[at] = (sorted(files), sorted(dirs), sorted(os.stat(os.path.join(at, f)).st_size for f in files))
    return out


def got(scanned):
    rows = scanned.collect()
    assert len({r.path for r in rows}) == len(rows)
    return {r.path: (r.files, r.dirs, sorted(r.sizes)) for r in rows}


@pytest.fixture(scope="module")
def top(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    os.makedirs(top / "wide")
    for i in range(3000):
        (top / "wide" / f"f{i}").write_text("x" * (i % 7))
    deep = top / "deep"
    for i in range(200):
        deep = deep / f"d{i % 10}"
    os.makedirs(deep)
    (deep / "end").write_text("end")
    for i in range(12):
        for k in range(12):
            os.makedirs(top / f"b{i}" / f"c{k}" / "e")
            (top / f"b{i}" / f"c{k}" / "file").write_text("y")
    return str(top)


@pytest.mark.parametrize(("first", "most", "piece"), [(500, 20_000, 5_000), (10, 150, 400), (1, 60, 7_000)])
def test_walk_in_rounds(spark, top, first, most, piece):
    assert got(filesystem.scan(spark, [top], first=first, most=most, piece=piece)) == plain(top)


def test_work_is_bounded_and_handed_back(top):
    rows = list(filesystem.visited([(top, top, None, None)], filesystem.Prefixes([]), 100, piece=400))
    waiting = [r for r in rows if r[0]]
    assert sum(len(r[5]) + len(r[8]) for r in rows if not r[0]) < 600 and waiting
    assert all(len(r[2]) <= 400 for r in waiting if r[2] is not None)


def test_skipped_and_missing_roots(spark, top):
    want = {k: v for k, v in plain(top).items() if not k.startswith(top + "/b1")}
    rows = got(filesystem.scan(spark, [top], [top + "/b1", top + "/b1/c2", ""]))
    assert set(rows) == set(want) and not any(d.startswith("b1") for d in rows[top][1])
    (row,) = filesystem.scan(spark, [top + "/nowhere"]).collect()
    assert row.errors and not row.files
    assert filesystem.scan(spark, [top], [top]).collect() == []


def test_prefixes_cover_as_brute_force():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("ab/") for _ in range(rng.randrange(1, 7)))
    prefixes = [word() for _ in range(60)] + [""]
    p = filesystem.Prefixes(prefixes)
    for _ in range(3000):
        path = word() + word()
        assert p.cover(path) == any(path.startswith(x) for x in prefixes if x)


def test_many_prefixes(spark):
    rng = random.Random(2)
    word = lambda n: "/" + "".join(rng.choice("abé/") for _ in range(rng.randrange(1, n)))
    prefixes = [p for p in (word(9) for _ in range(400)) if len(p) > 4] + ["", "/ab\U0010ffff"]
    paths = [(i, word(12)) for i in range(2000)] + [(-1, None), (-2, "/ab\U0010ffffx"), (-3, "/abz")]
    rows = filesystem.without_prefixes(spark.createDataFrame(paths, "at long, full_path string"), prefixes)
    want = [r for r in paths if r[1] is None or not any(r[1].startswith(p) for p in prefixes if p)]
    assert rows.columns == ["at", "full_path"] and sorted(map(tuple, rows.collect())) == sorted(want) and len(want) > 10
    few = filesystem.without_prefixes(spark.createDataFrame(paths, "at long, full_path string"), prefixes[:20])
    assert sorted(map(tuple, few.collect())) == sorted(r for r in paths if r[1] is None or not any(r[1].startswith(p) for p in prefixes[:20]))


def test_overlapping_roots(spark):
    roots = ["/a", "/a/b", "/a/bc", "/a/b/c", "/a/b", "/d", "/"]
    rows = filesystem.overlaps(spark.createDataFrame([(r, "Linux") for r in roots], "path string, os_name string")).collect()
    assert {(r.path, r.n_same, r.n_above, r.n_below) for r in rows} == {("/", 1, 0, 5), ("/a", 1, 1, 3), ("/a/b", 2, 2, 1), ("/a/bc", 1, 2, 0), ("/a/b/c", 1, 3, 0), ("/d", 1, 1, 0)}


def test_far_pages(spark):
    rows = [(f"/p{i}", (i * 7919) % 101) for i in range(1200)]
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    ranking = content.Ranking(spark.createDataFrame(rows, "full_path string, size long"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(ranking.counts) > 1
    for page in (0, 14, 29, 59, 60):
        assert [tuple(r) for r in ranking.page(page).collect()] == want[page * 20 : page * 20 + 20]
