"""Duplicates in stages against whole contents, and the bytes that are read."""

import os

from arborlake.operators import staged


def test_stages_find_what_contents_say(spark, tmp_path):
    base = bytes(range(256)) * 40
    contents = {"a": base, "b": base, "c": base[:5000] + b"!" + base[5001:], "d": b"x" + base[1:], "e": b"short", "f": b"short", "g": b"tiny!", "h": b"", "i": b"", "j": b"alone in its size" * 99}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    rows = [(str(tmp_path / n), len(d)) for n, d in contents.items()] + [(str(tmp_path / "gone"), 5), (str(tmp_path / "a"), len(base)), (None, 3)]
    got = {os.path.basename(r.full_path): r for r in staged.alike(spark.createDataFrame(rows, "full_path string, size long"), ends=100, most=999).collect()}
    groups = {}
    for n, r in got.items():
        if r.digest:
            groups.setdefault(r.digest, set()).add(n)
    assert sorted(map(sorted, groups.values())) == [["a", "b"], ["e", "f"], ["h", "i"]]
    n = len(base)
    assert {k: r.bytes_read for k, r in got.items()} == {"a": n + 200, "b": n + 200, "c": n + 200, "d": 200, "e": 5, "f": 5, "g": 5, "h": 0, "i": 0, "j": 0, "gone": 0}
    summary = staged.duplicate_groups(staged.alike(spark.createDataFrame(rows, "full_path string, size long"), ends=100, most=999)).collect()
    assert sorted((r.copies, r.size, r.wasted) for r in summary) == [(2, 0, 0), (2, 5, 5), (2, n, n)]


def test_one_large_sparse_file_is_many_parts(spark, tmp_path):
    for name, last in (("x", b"1"), ("y", b"1"), ("z", b"2")):
        with open(tmp_path / name, "wb") as f:
            f.truncate(200 << 20)
            f.seek(100 << 20)
            f.write(last)
    rows = [(str(tmp_path / n), 200 << 20) for n in "xyz"]
    got = staged.alike(spark.createDataFrame(rows, "full_path string, size long"), most=16 << 20).collect()
    digests = {os.path.basename(r.full_path): r.digest for r in got}
    assert digests["x"] == digests["y"] and digests["x"] and digests["z"] is None
