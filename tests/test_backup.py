"""Packing against a loop, with keys and volumes that span many blocks and partitions; archives of several keys and of awkward files."""

import os
import random
import zipfile

import pytest

from arborlake.operators import backup

ROWS = "k string, seq long, size long, source_exists boolean"


def loop(rows, most):
    state, out = {}, []
    for k, i, size, there in sorted(rows, key=lambda r: r[1]):
        index, held = state.get(k, (0, 0))
        if held > 0 and held + (size or 0) > most:
            index, held = index + 1, 0
        state[k] = index, held + ((size or 0) if there else 0)
        out.append((i, index))
    return sorted(out)


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("sizes", "most", "missing", "block"), [([0, 1, 5, 50, 99, 100, 101, 250], 100, 0.0, 64), ([0, 1, 5, 50, 99, 100, 101, 250], 100, 0.3, 16), ([7], 100, 0.0, 10), ([1], 700, 0.1, 32), ([0], 10, 0.0, 8), ([None, 3, 10_000], 5_000, 0.5, 16)])
def test_pack_is_a_loop(many_parts, sizes, most, missing, block):
    rng = random.Random(len(sizes) + most + block)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None, f"k{rng.randrange(40)}"]), i, rng.choice(sizes), rng.random() >= missing) for i in range(1500)]
    want = loop(rows, most)
    rng.shuffle(rows)
    got = backup.pack(many_parts.createDataFrame(rows, ROWS), ["k"], ["seq"], most, block=block)
    assert sorted((r.seq, r.zip_index) for r in got.collect()) == want


def test_one_key_of_many_files(many_parts):
    rng = random.Random(5)
    rows = [("all", i, int(rng.paretovariate(0.8) * 10), rng.random() > 0.05) for i in range(100_000)]
    got = backup.pack(many_parts.createDataFrame(rows, ROWS), ["k"], ["seq"], 50_000, block=4096).select("seq", "zip_index")
    assert sorted(tuple(r) for r in got.toLocalIterator()) == loop(rows, 50_000)


def test_pack_of_nothing(spark):
    assert backup.pack(spark.createDataFrame([], ROWS), ["k"], ["seq"], 10).collect() == []


def test_archives_of_two_keys(spark, tmp_path):
    for key in ("p", "q"):
        for i in range(4):
            (tmp_path / f"{key}{i}").write_bytes(bytes([65 + i]) * 6)
    os.utime(tmp_path / "p1", (0, 0))  # before archives' first year
    files = [(k, i, 0, str(tmp_path / f"{k}{i}"), 6) for k in ("p", "q") for i in range(4)] + [("q", 9, 0, str(tmp_path / "gone"), 1)]
    packed = backup.volumes(backup.pack(spark.createDataFrame(files, "snapshot string, seq long, pos int, full_path string, size long"), ["snapshot"], ["seq", "pos"], 12), ["snapshot"])
    plan = backup.manifest(packed, "/b").collect()
    held = {}
    for r in plan:
        held[r.dest_path] = held.get(r.dest_path, 0) + r.filesize
    assert len(held) == 5 and max(held.values()) <= 12
    done = backup.write_zip(packed, str(tmp_path / "out")).collect()
    assert [r.src_path for r in done if r.result != "success"] == [str(tmp_path / "gone")]
    found = {n: zipfile.ZipFile(tmp_path / "out" / z).read(n) for z in os.listdir(tmp_path / "out") for n in zipfile.ZipFile(tmp_path / "out" / z).namelist()}
    assert found == {str(tmp_path / f"{k}{i}").lstrip("/"): bytes([65 + i]) * 6 for k in ("p", "q") for i in range(4)}
    assert all(z.endswith(".zip") for z in os.listdir(tmp_path / "out"))


def test_half_a_member_does_not_stay(tmp_path, monkeypatch):
    (tmp_path / "good").write_text("good")
    (tmp_path / "bad").write_text("bad" * 1000)

    def fails(source, target, size):
        target.write(source.read(10))
        if source.name.endswith("bad"):
            raise ValueError("broken")
        target.write(source.read())

    monkeypatch.setattr(backup.shutil, "copyfileobj", fails)
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        with pytest.raises(ValueError):
            backup._add(z, str(tmp_path / "bad"))
        backup._add(z, str(tmp_path / "good"))
    with zipfile.ZipFile(tmp_path / "z.zip") as z:
        assert z.testzip() is None and [n.rpartition("/")[2] for n in z.namelist()] == ["good"]
