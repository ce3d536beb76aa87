"""Replicas against plain Python, on odd rows, and how often their rows are dealt out."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from arborlake.operators import content

DEVICES = [(1, "mobile"), (2, "mobile"), (3, "server"), (4, None), (5, "mobile"), (5, "mobile"), (6, "mobile"), (6, "server"), (None, "mobile")]
#: Contents on few devices; one in many copies on one device and one on many; contents and devices that are null or unknown; and rows that come twice.
HELD = (
    [(f"h{i}", i % 9) for i in range(3000)]
    + [("pair", 1)] * 500
    + [("wide", i) for i in range(700)]
    + [(None, 1 + i % 2) for i in range(300)]
    + [("", None), ("", None), ("two", 1), ("two", 1), ("two", 2), ("none", None), ("none", 2), ("far", 77), ("again", 5), ("both", 6), ("untyped", 4), (None, None)]
)


def plain(held, devices):
    types, of = defaultdict(list), defaultdict(set)
    for device, kind in devices:
        if device is not None:
            types[device].append(kind)
    for h, device in held:
        of[h].add(device)
    known = {h: [kind for device in found for kind in types.get(device, [None])] for h, found in of.items()}
    return Counter((h, len(kinds), all(kind == "mobile" for kind in kinds)) for h, kinds in known.items())


@pytest.fixture
def threshold(spark):
    yield lambda size: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges(df):
    """The columns that each exchange by a hash deals out by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sorted(re.sub(r"#\d+L?|, \d+$", "", x) for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan))


@pytest.mark.parametrize("size", ["10m", "-1"])
@pytest.mark.parametrize("held", [HELD, HELD[:1000], HELD[3000:], []])
def test_replicas_as_counted_in_plain_python(spark, threshold, held, size):
    threshold(size)
    rows, devices = spark.createDataFrame(held, "hash string, device_id long"), spark.createDataFrame(DEVICES, "device_id long, device_type string")
    expected = plain(held, DEVICES)
    for few in (False, True):
        out = content.replicas(rows, devices, few)
        assert out.dtypes == [("hash", "string"), ("replicas", "bigint"), ("mobile_only", "boolean")]
        assert Counter(map(tuple, out.collect())) == expected
    assert Counter(map(tuple, content.at_risk(rows, devices).collect())) == Counter({x: n for x, n in expected.items() if x[1] == 1 or x[2]})


def test_rows_are_dealt_out_once_and_once_more_for_a_large_table_of_devices(spark, threshold):
    devices = spark.range(7).select((F.col("id") % 7).alias("device_id"), F.lit("mobile").alias("device_type"))
    held = spark.range(20_000).select((F.col("id") % 5000).alias("hash"), (F.col("id") % 7).alias("device_id"))
    for size, expected in (("10m", ["device_id", "hash"]), ("-1", ["device_id", "device_id", "hash"])):  # one by device_id is that of the devices
        threshold(size)
        assert exchanges(content.at_risk(held, devices)) == expected


def test_a_common_content_is_told_apart_by_all_tasks(spark):
    devices = spark.range(7).select(F.col("id").alias("device_id"), F.lit("mobile").alias("device_type"))
    held = spark.range(20_000).select(F.when(F.col("id") % 5 > 0, F.col("id")).alias("hash"), (F.col("id") % 1000).alias("device_id"))
    assert content._common(held.select(F.xxhash64("hash").alias("key"))) == [spark.range(1).select(F.xxhash64(F.lit(None).cast("long"))).first()[0]]
    assert "hash, device_id" in exchanges(content.at_risk(held, devices))
    assert content.replicas(held, devices, few=True).where("hash IS NULL").first()["replicas"] == 200
