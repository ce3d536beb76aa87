"""Ranks and running sums against a plain loop, with keys that span many partitions."""

import random

import pytest

from arborlake.operators.ordered import running


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_running_is_a_loop(spark, share):
    rng = random.Random(int(share * 10))
    rows = [(None if rng.random() < 0.1 else "hot" if rng.random() < share else f"k{rng.randrange(9)}", i, rng.randrange(-9, 1)) for i in range(3000)]
    want, state = [], {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        n, s, m = state.get(k, (0, 0, None))
        state[k] = n + 1, s + v, v if m is None else max(m, v)
        want.append((k, i, v, n, state[k][1], state[k][2]))
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = running(spark.createDataFrame(rows, "k string, i long, v long"), ["k"], ["i"], {"s": "v"}, {"m": "v"}, "n")
        assert out.select("__part").distinct().count() > 2
        got = [tuple(r) for r in out.select("k", "i", "v", "n", "s", "m").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_running_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, i long, v long")
    assert running(empty, ["k"], ["i"], {"s": "v"}, rank="n").collect() == []
    assert running(empty.unionAll(spark.createDataFrame([("a", 1, 2), ("b", 1, 3)], empty.schema)), [], ["k"], {"s": "v"}).select("s").collect() == [(2,), (5,)]
