"""The streamed log after restarts, late and repeated lines, against the replay of all lines at once."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from arborlake.operators import groups
from arborlake.streaming import replay

LOG = "snapshot string, seq long, path string, kind string, group string, action string"


@pytest.mark.parametrize("fold", [50, 2])
def test_restarts_late_and_repeated_lines(spark, tmp_path, fold):
    rng = random.Random(fold)
    rows = [("s", i, rng.choice([f"/p{k}" for k in range(30)]), rng.choice("fd"), rng.choice(["g", None]), rng.choice(["add", "del", "other"])) for i in range(400)]
    parts = [rows[:100], rows[200:], rows[100:200], rows[50:150], rows[:0]]
    folder, source = str(tmp_path / "state"), tmp_path / "log"
    for n, part in enumerate(parts):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").json(str(source))
        stream = replay.start(spark.readStream.schema(LOG).json(str(source)), folder, str(tmp_path / "checkpoint"), fold=fold)
        stream.processAllAvailable()
        stream.stop()
        seen = spark.createDataFrame([r for p in parts[: n + 1] for r in p], LOG)
        assert sorted(map(tuple, replay.current(spark, folder).collect()), key=repr) == sorted(map(tuple, groups.replay(seen).select("snapshot", "group", "kind", "path").collect()), key=repr)
    changes = spark.read.parquet(f"{folder}/changes").groupBy("batch").count().orderBy(F.desc("batch")).first()
    assert changes is None or changes["count"] <= 200  # a batch writes its own members, not the state


def test_missing_changes_are_an_error(spark, tmp_path):
    folder = str(tmp_path / "state")
    assert replay.current(spark, folder).collect() == []
    source = tmp_path / "log"
    for i in range(2):
        spark.createDataFrame([("s", i, f"/p{i}", "f", "g", "add")], LOG).coalesce(1).write.mode("append").json(str(source))
        stream = replay.start(spark.readStream.schema(LOG).json(str(source)), folder, str(tmp_path / "checkpoint"))
        stream.processAllAvailable()
        stream.stop()
    assert replay.current(spark, folder).count() == 2
    shutil.rmtree(tmp_path / "state" / "changes" / "batch=0")
    with pytest.raises(FileNotFoundError):
        replay.current(spark, folder)


def test_a_batch_of_many_members_is_grouped_without_a_call_for_each(spark, tmp_path, capsys):
    """A call of Python for each member takes a millisecond, for millions of members longer than all else."""
    log = spark.range(40_000).selectExpr("'s' AS snapshot", "id AS seq", "concat('/p', id % 20000) AS path", "'f' AS kind", "'g' AS group", "if(id % 3 = 0, 'del', 'add') AS action")
    folder, source = str(tmp_path / "state"), str(tmp_path / "log")
    log.where("seq < 30000").write.mode("append").json(source)
    for late in (log.where("seq >= 10000"), log.where("seq < 20000")):
        stream = replay.start(spark.readStream.schema(LOG).json(source), folder, str(tmp_path / "checkpoint"))
        stream.processAllAvailable()
        capsys.readouterr()
        stream.explain()
        plan = capsys.readouterr().out
        assert "StateStoreSave" in plan and "Pandas" not in plan and "Python" not in plan
        stream.stop()
        late.write.mode("append").json(source)
    want = log.where("seq >= 20000 AND action = 'add'").select("path")
    assert sorted(r.path for r in replay.current(spark, folder).collect()) == sorted(r.path for r in want.collect())
