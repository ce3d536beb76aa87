"""Indexed snapshots: the same rows as plain ones, readable by anything, and look-ups that read no other bytes."""

import glob
import gzip
import json

import pytest
from pyspark.sql import functions as F

from arborlake.hub import Hub
from arborlake.sources import indexed, snapshots

DIRS = "snapshot string, seq long, path string, root string, os_name string"
ENTRIES = "snapshot string, seq long, pos int, kind string, parent string, name string, full_path string, size long, created long, modified long, accessed long"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("indexed") / "snapshot_1_300.jsonl.gz")
    dirs = spark.createDataFrame([("s", i, f"/r/d{i}" if i else "/r", "/r", "Linux") for i in range(300)], DIRS)
    entries = spark.createDataFrame([("s", i, k, "f", f"/r/d{i}" if i else "/r", f'né"\t{k}😀', f"/r/d{i}/n{k}", i * k, 1, 2, k) for i in range(300) for k in range(i % 4)], ENTRIES)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    indexed.write_indexed(dirs, entries, "file://" + folder, {"os_name": "Linux", "device_name": "d"})
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return folder, dirs, entries


def test_whole_and_plain_readers(spark, made):
    folder, dirs, entries = made
    parts = glob.glob(folder + "/part-*.gz")
    assert len(parts) > 1
    lines = [json.loads(x) for p in parts for x in gzip.open(p, "rt", encoding="utf-8")]
    assert len(lines) == 300 and sum("device_name" in x for x in lines) == 1
    assert spark.read.text("file://" + folder).count() == 300
    rows = snapshots.entries_of(indexed.read_indexed(spark, "file://" + folder)).select("seq", "name", "size", "accessed")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, entries.select("seq", "name", "size", "accessed").collect()))
    assert snapshots.metadata(indexed.read_indexed(spark, "file://" + folder)).first().device_name == "d"


def test_lookups_read_no_other_bytes(spark, made, tmp_path):
    """All bytes but those of the wanted members are overwritten; the look-up does not notice."""
    import os
    import shutil

    folder = str(tmp_path / "copy.jsonl.gz")
    shutil.copytree(made[0], folder)
    wanted = [f"/r/d{i}" for i in (7, 8, 9, 250)] + ["/r/nowhere"]
    index = [r for r in indexed.read_index(spark, "file://" + folder).collect()]
    keep = {(r.file, r.at): r.size for r in index if r.p in wanted}
    for f in {r.file for r in index}:
        path = os.path.join(folder, f)
        data = bytearray(b"\xff" * os.path.getsize(path))
        whole = open(path, "rb").read()
        for (file, at), size in keep.items():
            if file == f:
                data[at : at + size] = whole[at : at + size]
        open(path, "wb").write(data)
    for crc in glob.glob(folder + "/.*.crc"):
        os.remove(crc)
    got = indexed.read_indexed(spark, "file://" + folder, spark.createDataFrame([(w,) for w in wanted], "p string")).select("p").collect()
    assert sorted(r.p for r in got) == sorted(wanted[:-1])


def test_ranges_join_neighbours_only():
    assert indexed.ranges([("a", 0, 5), ("a", 5, 5), ("a", 11, 4), ("b", 15, 1)], 100) == [("a", 0, 10, 2), ("a", 11, 4, 1), ("b", 15, 1, 1)]
    assert indexed.ranges([("a", 0, 50), ("a", 50, 60)], 100) == [("a", 0, 50, 1), ("a", 50, 60, 1)]


def test_index_lengths_are_those_of_json(spark, made):
    _, dirs, entries = made
    got = {r.p: r.compressed_length for r in snapshots.index_projection(dirs, entries).collect()}
    for i in (0, 1, 2, 3, 299):
        files = [(f'né"\t{k}😀', i * k, [1, 2, k]) for k in range(i % 4)]
        line = {"f": [f[0] for f in files], "d": [], "t": [f[2] for f in files], "T": [], "s": [f[1] for f in files]}
        assert got[f"/r/d{i}" if i else "/r"] == len(json.dumps(line))


def test_hub_with_index(spark, tmp_path):
    top = tmp_path / "top"
    for n in ("a/one.txt", "b/Two.txt"):
        (top / n).parent.mkdir(parents=True)
        (top / n).write_text(n)
    h = Hub(spark, str(tmp_path / "hub"))
    h.scan([str(top)], save=True, use_index=True)
    (row,) = h.snapshots().collect()
    name = row.filename.removesuffix(".jsonl.gz")
    h.load(name)
    assert h.info(name).first().total_files == 2 and row.size > 0
    plain = h.search("TWO", [name]).select("name", "full_path").collect()
    h.index_names(name)
    assert h.search("TWO", [name]).select("name", "full_path").collect() == plain and len(plain) == 1
    assert h.search("b", [name]).where(F.col("type") == "directory").count() == 1
