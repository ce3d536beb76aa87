"""Searches by index against full searches, and what they read as the table grows."""

import random

import pytest
from pyspark.sql import functions as F

from arborlake.operators import name_index, search

ENTRIES = "snapshot string, seq long, pos int, kind string, parent string, name string, full_path string, size long, created long, modified long, accessed long"


def entries(spark, n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh%_é.") for _ in range(rng.randrange(0, 9)))
    rows = [("s", i, 0, rng.choice("fd"), "/", word().title() if i % 50 else None, "/x", i, 1, 2, 3) for i in range(n)]
    rows += [("t", -1, 0, "f", "/", "Needle-in-hay.TXT", "/n", 1, 1, 1, 1)] * 2
    return spark.createDataFrame(rows, ENTRIES)


def test_rows_of_a_full_search(spark, tmp_path):
    table = entries(spark, 3000)
    name_index.build(table, str(tmp_path), file_rows=300)
    for text in ("", "a", "ab", "abc", "bcab", "%", "_a", "é.", "starts:", "starts:a", "starts:AB", "starts:abc", "ends:", "ends:h", "ends:gh", "ends:cgh", "needle-in-hay.txt", "DLE-in", "no such name", "aaa", "starts:needle", "ends:.TXT"):
        want = search.search(table, text)
        got = name_index.indexed_search(spark, str(tmp_path), text)
        assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr), text
    only = name_index.indexed_search(spark, str(tmp_path), "abc", ["t"]).collect()
    assert only == []


@pytest.mark.parametrize("n", [4000])
def test_files_opened_do_not_grow_with_the_table(spark, tmp_path, n):
    opened = []
    for k, size in (("small", n), ("large", 10 * n)):
        name_index.build(entries(spark, size), str(tmp_path / k), file_rows=500)
        read = spark.read.parquet(str(tmp_path / k / "grams"))
        bounds = read.groupBy(F.input_file_name().alias("file")).agg(F.min("gram").alias("low"), F.max("gram").alias("high")).collect()
        grams = name_index.term_grams("needle-in")
        hit = sum(any(b.low <= g <= b.high for g in grams) for b in bounds)
        opened.append((hit, len(bounds)))
    (few, all_few), (many, all_many) = opened
    assert all_many > 2 * all_few and many <= few + 3 and many < all_many / 3
