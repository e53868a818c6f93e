import datetime as dt
import os

from spanwork.streaming import progress

T0 = dt.datetime(2025, 1, 1)


def run(spark, tmp_path, batches, schema, build, mode="append"):
    """Files arrive one after the other; the result is what the sink holds at the end."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"b{n}"))
        for file in (source / f"b{n}").iterdir():  # files are read in the order of their times
            os.utime(file, (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    rows: list = []
    query = build(stream).writeStream.outputMode(mode).option("checkpointLocation", str(out)).foreachBatch(lambda df, n: rows.extend(df.collect())).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return rows


def at(m):
    return T0 + dt.timedelta(minutes=m)


def test_repeats_count_once(spark, tmp_path):
    batches = [[("a", at(0)), ("b", at(1))], [("a", at(5)), ("c", at(6))], [("b", at(7))]]
    got = run(spark, tmp_path, batches, "task_id string, ts timestamp_ntz", lambda s: progress.first_deliveries(s, "task_id", "ts"))
    assert sorted(r.task_id for r in got) == ["a", "b", "c"]


def test_running_funnel(spark, tmp_path):
    batches = [[("draw", at(1)), ("draw", at(2))], [("mesh", at(3)), ("draw", at(15))], [("draw", at(200))], [("draw", at(201))], [("mesh", at(4))]]
    got = run(spark, tmp_path, batches, "stage string, ts timestamp_ntz", lambda s: progress.running_funnel(s, "stage", "ts"))
    assert {(r.start, r.stage, r.n) for r in got if r.start < at(100)} == {(at(0), "draw", 2), (at(0), "mesh", 1), (at(10), "draw", 1)}


def test_loops_are_seen_while_they_happen(spark, tmp_path):
    batches = [[("t1", "x"), ("t1", "x"), ("t2", "y")], [("t1", "x"), ("t2", "z"), ("t2", "y")], [("t1", "x"), ("t2", "y"), ("t2", "y")]]
    got = run(spark, tmp_path, batches, "task_id string, code string", lambda s: progress.loops(s, "task_id", "code"))
    assert sorted((r.task_id, r.code, r.run) for r in got) == [("t1", "x", 3), ("t2", "y", 3)]
