"""Snapshots, trees, groups, search, packing and writers on hand-made rows, and against plain recursion."""

import gzip
import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from arborlake.functions import paths
from arborlake.hub import Hub
from arborlake.operators import backup, content, groups, search, tree
from arborlake.sources import filesystem, host, snapshots

LINES = [
    {"p": "/r", "f": ["a.txt", "b.bin"], "d": ["x", "ln", "y"], "s": [10, 1152], "t": [[1, 2, 3], [4, 5, 6]], "T": [[7, 8, 9]] * 3, "os_name": "Linux", "device_name": "dev"},
    {"p": "/r/x", "f": ["c.txt"], "d": ["z"], "s": [100], "t": [[1, 1, 1]], "T": [[1, 1, 1]]},
    {"p": "/r/x/z", "f": ["d.txt", "e.TXT"], "d": [], "s": [1000], "t": [[1, 1, 1]], "T": []},
    {"p": "/r/y", "f": ["f%.log"], "d": [], "s": [5], "t": [[1, 1, 1]], "T": []},
    {"p": "/r/q", "f": ["g"], "d": [], "s": [7], "t": [[1, 1, 1]], "T": []},
]
ACTIONS = [["/r/x", "d", "keep", "add", 1], ["/r/x/z/d.txt", "f", "junk", "add", 2], ["/r/y/f%.log", "f", "solo", "add", 3], ["/r/a.txt", "f", "keep", "add", 4], ["/r/b.bin", "f", "keep", "add", 5], ["/r/b.bin", "f", "keep", "del", 6], ["/r/none", "f", "ghost", "del", 7], ["/r", "d", "rootg", "add", 8]]


@pytest.fixture(scope="module")
def hub(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("hub")
    os.makedirs(top / "snapshots")
    with gzip.open(top / "snapshots/snapshot_17_5.jsonl.gz", "wt") as f:
        f.write("".join(json.dumps(x) + "\n\n" for x in LINES))
    (top / "snapshots/snapshot_17_5_groups.jl").write_text("".join(json.dumps(a) + "\n" for a in ACTIONS))
    h = Hub(spark, str(top))
    h.load("snapshot_17_5")
    return h


S = "snapshot_17_5"


def names(df):
    return sorted(r.name for r in df.collect())


def test_totals_listing_and_info(hub):
    held = hub.loaded[S]
    assert {r.path: (r.S, r.C) for r in held["totals"].collect()} == {"/r": (2267, 6), "/r/x": (1100, 3), "/r/x/z": (1000, 2), "/r/y": (5, 1), "/r/q": (7, 1)}
    info = hub.info(S).first()
    assert (info.path_count, info.total_files, info.total_dirs, info.total_size, info.root_path) == (5, 7, 4, 2274, "/r")
    shown = hub.list_path(S, "/r")
    assert {r.name: (r.S, r.C) for r in shown["dirs"].collect()} == {"x": (1100, 3), "ln": (None, None), "y": (5, 1)}
    assert {r.name: (r.size_formatted, r.created) for r in shown["files"].collect()} == {"a.txt": ("10.00 B", 1), "b.bin": ("1.12 KB", 4)}
    assert shown["page"].first().total_size_formatted == "2.21 KB"
    assert names(hub.list_path(S, index=2)["files"]) == ["d.txt", "e.TXT"]
    assert hub.snapshots().first().timestamp == 17


def test_group_counts_and_filters(hub):
    assert {r.group: (r.files, r.dirs, r.total) for r in hub.group_counts(S).collect()} == {"keep": (1, 1, 2), "junk": (1, 0, 1), "solo": (1, 0, 1), "ghost": (0, 0, 0), "rootg": (0, 1, 1)}
    kept = hub.list_path(S, "/r", filter_in=["keep"], recursive=True)
    assert names(kept["files"]) == ["a.txt"] and [(r.name, r.S, r.C) for r in kept["dirs"].collect()] == [("x", 0, 0)]
    out = hub.list_path(S, "/r", filter_out=["junk"], recursive=True)
    assert {r.name: (r.S, r.C) for r in out["dirs"].collect()} == {"x": (100, 2), "y": (5, 1), "ln": (None, None)}


@pytest.mark.parametrize("inside,outside,want", [([], [], "a.txt b.bin c.txt d.txt e.TXT f%.log"), (["keep"], [], "a.txt c.txt d.txt e.TXT"), (["keep"], ["junk"], "a.txt c.txt e.TXT"), ([], ["keep"], "b.bin f%.log"), (["solo"], [], ""), (["rootg"], [], ""), (["unknown"], [], ""), ([], ["unknown"], "a.txt b.bin c.txt d.txt e.TXT f%.log")])
def test_selection(hub, inside, outside, want):
    assert names(hub.select(S, inside, outside)) == want.split()


def test_selection_intuitive(hub):
    assert names(hub.select(S, ["solo"], mode="intuitive")) == ["f%.log"]


def walk_select(path, kids, files, g, inside, outside, leads, included, root):
    got = []
    for f in files.get(path, []):
        full = path.rstrip("/") + "/" + f
        if any(full in g.get((n, "f"), ()) for n in outside):
            continue
        if not inside or included or ((path == root or path in leads) and any(full in g.get((n, "f"), ()) for n in inside)):
            got.append(full)
    for k in kids.get(path, []):
        if any(k in g.get((n, "d"), ()) for n in outside):
            continue
        got += walk_select(k, kids, files, g, inside, outside, leads, included or any(k in g.get((n, "d"), ()) for n in inside), root)
    return got


def test_selection_equals_recursion(spark):
    rng = random.Random(9)
    for _ in range(4):
        all_dirs, kids, files = ["/r"], {}, {}
        for i in range(14):
            up = rng.choice(all_dirs)
            kids.setdefault(up, []).append(f"{up}/d{i}")
            all_dirs.append(f"{up}/d{i}")
        for i in range(40):
            files.setdefault(rng.choice(all_dirs), []).append(f"f{i}")
        paths_of = [(d, "d") for d in all_dirs] + [(f"{d}/{f}", "f") for d, fs in files.items() for f in fs]
        log = [(*rng.choice(paths_of), rng.choice("ABC")) for _ in range(22)]
        g = {}
        for p, kind, name in log:
            g.setdefault((name, kind), set()).add(p)
        dirs = spark.createDataFrame([("s", i, d, "/r", "Linux", 0, len(files.get(d, []))) for i, d in enumerate(all_dirs)], "snapshot string, seq long, path string, root string, os_name string, direct_size long, n_files long")
        entries = spark.createDataFrame([("s", "f", d, f, f"{d}/{f}", 1) for d, fs in files.items() for f in fs], "snapshot string, kind string, parent string, name string, full_path string, size long")
        members = spark.createDataFrame([("s", n, k, p) for p, k, n in set(log)], "snapshot string, group string, kind string, path string")
        for inside, outside in ((["A"], []), (["A", "B"], ["C"]), ([], ["C"])):
            closure = {p for n in inside for d in g.get((n, "d"), ()) for p in ["/".join(d.split("/")[:i]) for i in range(2, d.count("/") + 2)]}
            want = walk_select("/r", kids, files, g, inside, outside, closure, False, "/r")
            got = [r.full_path for r in groups.select(entries, dirs, members, inside, outside).collect()]
            assert sorted(got) == sorted(want)


def test_search_is_literal(hub):
    assert names(hub.search("ends:.txt", [S])) == ["a.txt", "c.txt", "d.txt", "e.TXT"]
    assert names(hub.search("%", [S])) == ["f%.log"]
    assert names(hub.search("starts:Z", [S])) == ["z"]
    assert names(hub.search("g", [S])) == ["f%.log", "g"]
    with pytest.raises(KeyError):
        hub.search("g", ["other"])


def test_packing_equals_a_loop(spark, hub):
    plan = hub.plan_backup(S, "/b", max_bytes=1152).collect()
    assert [r.dest_path for r in sorted(plan, key=lambda r: r.dest_path)] == ["/b/backup_000.zip", "/b/backup_001.zip", *["/b/backup_002.zip"] * 4]
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(5)}", i, rng.choice([0, 1, 5, 50, 99, 100, 101, 250])) for i in range(300)]
    want, state = [], {}
    for k, i, size in rows:
        index, held = state.get(k, (0, 0))
        if held > 0 and held + size > 100:
            index, held = index + 1, 0
        state[k] = index, held + size
        want.append((i, index))
    got = backup.pack(spark.createDataFrame(rows, "k string, seq long, size long"), ["k"], ["seq"], 100).collect()
    assert sorted((r.seq, r.zip_index) for r in got) == want


def test_scan_write_read_and_back_up(spark, tmp_path):
    top = tmp_path / "t"
    for name, text in (("a/x.txt", "one"), ("a/.hidden", "two"), ("b/empty", ""), ("b/c/x.txt", "one"), ("skip/me", "no")):
        os.makedirs((top / name).parent, exist_ok=True)
        (top / name).write_text(text)
    os.symlink(top / "a", top / "link")
    os.symlink(top / "nowhere", top / "broken")
    scanned = filesystem.scan(spark, [str(top)], [str(top / "skip")])
    dirs, entries = filesystem.as_tables(scanned, "s")
    assert names(entries.where("kind = 'f'")) == [".hidden", "empty", "x.txt", "x.txt"]
    assert names(entries.where("kind = 'd'")) == ["a", "b", "c", "link"]
    assert filesystem.counters(scanned).first().n_errors == 1 and filesystem.errors(scanned).count() == 1
    total = tree.rollup(dirs, entries).where(F.col("path") == str(top)).first()
    assert (total.S, total.C) == (9, 4)
    snapshots.write_snapshot(dirs, entries, str(tmp_path / "snapshot_1_4.jsonl.gz"))
    again = snapshots.entries_of(snapshots.read_lines(spark, str(tmp_path / "snapshot_1_4.jsonl.gz")))
    key = ["kind", "full_path", "size", "created", "modified"]
    assert sorted(map(tuple, again.select(key).collect()), key=repr) == sorted(map(tuple, entries.select(key).collect()), key=repr)
    hashed = content.hash_files(entries.where("kind = 'f'"))
    twice = content.duplicates(hashed.join(entries, F.col("file_path") == F.col("full_path"))).collect()
    assert [(r.copies, r.size, r.wasted) for r in twice] == [(2, 3, 3)]
    files = entries.where("kind = 'f'")
    done = backup.write_zip(backup.volumes(backup.pack(files, ["snapshot"], ["seq", "pos"], 5), ["snapshot"]), str(tmp_path / "zips")).collect()
    assert {r.result for r in done} == {"success"}
    inside = [n for z in os.listdir(tmp_path / "zips") for n in zipfile.ZipFile(tmp_path / "zips" / z).namelist()]
    assert len(inside) == 4
    copied = backup.copy_folder(files, str(tmp_path / "copy")).collect()
    assert all(os.path.exists(r.dest_path) for r in copied)
    assert snapshots.index_projection(dirs, entries).count() == 4


def test_devices_and_media(spark, tmp_path):
    h = Hub(spark, str(tmp_path))
    device = host.system_info(spark)
    media = spark.createDataFrame([("disk", "d1", 10, 1)], snapshots.MEDIA)
    h.add_device(device, media)
    h.add_device(device)
    name = device.first().host_name
    assert h.devices().count() == 2 and snapshots.host_known(h.devices(), name) and not snapshots.host_known(h.devices(), "?")
    assert h.media(name).first().size == 10 and h.media("nobody").count() == 0
    assert host.os_release('# c\nNAME="X y"\n\nID=z') == {"NAME": "X y", "ID": "z"}


def test_group_append(spark, hub):
    hub.group_add(S + "_new", ['/r/"q"'], "f", "g")
    hub.group_remove(S + "_new", ["/r/other"], "f", "g")
    assert [r.path for r in hub.groups(S + "_new").collect()] == ['/r/"q"']


def test_appended_batches_are_replayed_in_order(spark, tmp_path):
    h = Hub(spark, str(tmp_path))
    assert h.groups("s").count() == 0 and h.group_counts("s").count() == 0  # no log, no groups
    os.makedirs(tmp_path / "snapshots", exist_ok=True)
    (tmp_path / "snapshots/s_groups.jl").write_text('["/old", "f", "g", "add", 1]\n["/a", "f", "g", "del", 2]\n')
    h.group_add("s", ["/a"], "f", "g")
    h.group_remove("s", ["/a", *[f"/{i}" for i in range(50)]], "f", "g")  # a larger file than the one before
    h.group_add("s", ["/b"], "f", "g")
    assert sorted(r.path for r in h.groups("s").collect()) == ["/b", "/old"]


@pytest.mark.parametrize("system", ["Linux", "Windows"])
def test_saved_scan_is_listed_and_loads_again(spark, tmp_path, system):
    for name in ("b/x", "a/y", "a/c/z"):
        os.makedirs((tmp_path / "t" / name).parent, exist_ok=True)
        (tmp_path / "t" / name).write_text(name)
    h = Hub(spark, str(tmp_path / "data"))
    dirs, entries = h.scan([str(tmp_path / "t")], save=True, os_name=system)
    assert sorted(r.seq for r in dirs.collect()) == [0, 1, 2, 3]
    listed = h.snapshots().collect()
    assert len(listed) == 1 and listed[0].timestamp > 0 and not listed[0].loaded
    name = listed[0].filename.removesuffix(".jsonl.gz")
    h.load(name)
    held = h.loaded[name]
    first = snapshots.metadata(held["lines"]).first()
    assert (first.snapshot, first.root, first.os_name) == (name, str(tmp_path / "t"), system) and first.host_name and first.start_scan_time
    assert held["dirs"].select("os_name").distinct().first().os_name == system and h.snapshots().first().loaded
    assert {(r.seq, r.path) for r in held["dirs"].collect()} == {(r.seq, r.path) for r in dirs.collect()}
    assert {r.kind for r in held["entries"].collect()} == {"f", "d"}


def test_look_up_errors(spark, hub, tmp_path):
    for wrong, error in (({"index": 99}, LookupError), ({"path": "/nowhere"}, LookupError), ({}, ValueError), ({"path": "/r", "index": 0}, ValueError)):
        with pytest.raises(error):
            hub.list_path(S, **wrong)
    with pytest.raises(KeyError):
        hub.load("snapshot_0_0")
    os.makedirs(tmp_path / "snapshots")
    with gzip.open(tmp_path / "snapshots/snapshot_1_0.jsonl.gz", "wt") as f:
        f.write("\n\n")
    with pytest.raises(ValueError, match="no lines"):
        Hub(spark, str(tmp_path)).load("snapshot_1_0")


def test_backup_log_and_missing_sources(spark, tmp_path):
    for name in ("a", "b", "c"):
        os.makedirs(tmp_path / "t", exist_ok=True)
        (tmp_path / "t" / name).write_text(name * 4)
    h = Hub(spark, str(tmp_path / "data"))
    h.scan([str(tmp_path / "t")], save=True)
    name = h.snapshots().first().filename.removesuffix(".jsonl.gz")
    h.load(name)
    os.remove(tmp_path / "t/b")
    plan = sorted((r.src_path[-1], r.dest_path[-7:], r.source_exists) for r in h.plan_backup(name, "/x", max_bytes=8).collect())
    assert plan == [("a", "000.zip", True), ("b", "000.zip", False), ("c", "001.zip", True)]
    done = h.run_backup(name, str(tmp_path / "zips"), max_bytes=8).collect()
    assert {r.dest_path[-7:] for r in done} == {"000.zip"}  # b adds no bytes
    assert sorted(r.action for r in done) == ["failed", "zip", "zip"]
    log = next(p for p in os.listdir(tmp_path / "data/backups") if p.endswith(".jl"))
    assert log.startswith(f"zips_{name}_3_")
    lines = [json.loads(x) for x in (tmp_path / "data/backups" / log).read_text().splitlines()]
    assert lines[0]["backup_type"] == "zip" and lines[0]["snapshot"] == name and len(lines) == 4 and {x["action"] for x in lines[1:]} == {"zip", "failed"}


def test_sorting_and_the_top_of_several_drives(spark, hub):
    by_size = [r.size for r in hub.search("", [S], by="size", descending=True).collect() if r.size is not None]
    assert by_size == sorted(by_size, reverse=True)
    with pytest.raises(ValueError, match="no column"):
        hub.search("", [S], by="colour")
    rows = spark.createDataFrame([("C:\\", "C:\\", ["f"], [5], [[1, 1, 1]], ["d"], [[1, 1, 1]], []), ("C:\\", "C:\\d", ["g"], [7], [[1, 1, 1]], [], [], []), ("D:\\", "D:\\", [], [], [], [], [], [])], filesystem.SCHEMA)
    dirs, entries = filesystem.as_tables(filesystem.under_top(rows, ["C:\\", "D:\\"]), "s", "Windows")
    assert {r.path: (r.S, r.C) for r in tree.rollup(dirs, entries).collect()} == {"/": (12, 2), "C:\\": (12, 2), "C:\\d": (7, 1), "D:\\": (0, 0)}


def test_thumbprint_takes_the_decimal_address(spark):
    import hashlib
    import platform
    import uuid

    row = host.system_info(spark).first()
    parts = [platform.node(), platform.machine(), platform.processor(), platform.system(), platform.release(), str(uuid.getnode())]
    assert row.thumbprint == hashlib.sha256("".join(parts).encode()).hexdigest() and row.device_type == "PC"


def test_windows_ancestors(spark):
    got = spark.range(1).select(paths.ancestors(F.lit("C:\\a\\b"), F.lit("/"), F.lit("Windows")).alias("a"), paths.ancestors(F.lit("/r"), F.lit("/r"), F.lit("Linux")).alias("b"), paths.ancestors(F.lit("/r/x"), F.lit("/r"), F.lit("Linux")).alias("c")).first()
    assert (got.a, got.b, got.c) == (["C:\\", "C:\\a", "C:\\a\\b"], [], ["/r/x"])


def test_search_modes(spark):
    rows = spark.createDataFrame([("A_b",), ("xa",)], "n string")
    assert [r.n for r in rows.where(search.matches(F.col("n"), "STARTS:a_")).collect()] == ["A_b"]
