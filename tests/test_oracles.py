"""Every query of the catalogue against its SQL in DuckDB."""

import gzip
import json
import math
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from arborlake.plans import catalogue
from arborlake.plans.catalogue import ORACLES, QUERIES
from arborlake.sources import single

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda x: None if isinstance(x, float) and math.isnan(x) else x
    return [columns[i] for i in order], sorted((tuple(cell(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLES[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(list(rel.columns), rel.fetchall())


def test_stream_replay_is_batch_replay(spark):
    assert sorted(QUERIES["q_stream_replay"](spark, SF).collect()) == sorted(QUERIES["q_group_replay"](spark, SF).collect())


def test_written_sources_are_spread_over_folders(spark, tmp_path, monkeypatch):
    """Tasks that all write into one folder wait for each other, the longer the more files it has."""
    docs = spark.range(0, 5000, 1, 3).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(catalogue, "fresh", lambda spark: f"file://{tmp_path}/files")
    got = QUERIES["q_source_exists"](spark, str(tmp_path)).collect()
    assert sorted((r.seq, r.full_path, r.source_exists) for r in got) == [(i, f"/s/en/doc_{i}.txt", i % 3 != 0) for i in range(5000)]
    sizes = Counter(at for at, _, names in os.walk(tmp_path / "files") for _ in names)
    assert sum(sizes.values()) == sum(i % 3 != 0 for i in range(5000)) and max(sizes.values()) <= 1000


def test_a_written_snapshot_has_each_entry_once(spark, tmp_path, monkeypatch):
    """Directories under one number would all list the entries of all of them."""
    monkeypatch.setattr(catalogue, "fresh", lambda spark: f"file://{tmp_path}")
    QUERIES["q_snapshot_metadata"](spark, SF).collect()
    with gzip.open(tmp_path / "snapshot_1_1.jsonl.gz", "rt") as f:
        lines = [json.loads(x) for x in f]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang").collect()
    assert lines[0]["p"] == "/" and [x["p"] for x in lines] == sorted({"/", *(f"/{r.source}" for r in docs), *(f"/{r.source}/{r.lang}" for r in docs)})
    assert sorted((x["p"], n) for x in lines for n in x["f"]) == sorted((f"/{r.source}/{r.lang}", f"doc_{r.doc_id}.txt") for r in docs)
    assert sum(len(x["d"]) for x in lines) == len(lines) - 1


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_lines_of_many_parts_stand_in_their_order(spark, tmp_path, compression):
    path = str(tmp_path / "lines")
    for n in (0, 1, 3000):
        single.write_lines(spark.range(n).select(F.col("id").cast("string").alias("value")).repartitionByRange(23, F.col("value").cast("long")).sortWithinPartitions(F.col("value").cast("long")), path, compression)
        with (gzip.open if compression == "gzip" else open)(path, "rt") as f:
            assert f.read().split() == [str(i) for i in range(n)]
        assert [x for x in os.listdir(tmp_path) if not x.endswith(".crc")] == ["lines"]
