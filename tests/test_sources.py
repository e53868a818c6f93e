import gzip
import io
import json
import tarfile

import pytest

from spanwork.sources import files as f

SCHEMA = "task_id string, v int"


def put(path, *lines):
    path.write_text("".join(f"{x}\n" for x in lines))
    return str(path)


def test_json_lines(spark, tmp_path):
    rows = [json.dumps({"task_id": str(i), "v": i}) for i in range(5)]
    path = put(tmp_path / "a.jsonl", *rows[:3], "", *rows[3:])
    assert f.json_lines(spark, path, SCHEMA).count() == 5
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress("\n".join(rows).encode()))
    assert f.json_lines(spark, str(tmp_path / "b.jsonl.gz"), SCHEMA).count() == 5
    with pytest.raises(Exception):
        f.json_lines(spark, put(tmp_path / "c.jsonl", rows[0], "{cut"), SCHEMA).collect()


def test_latest_line_wins(spark, tmp_path):
    lines = [json.dumps({"task_id": str(i % 50), "v": i}) for i in range(2000)]
    got = {r.task_id: r.v for r in f.latest_lines(spark, put(tmp_path / "j.jsonl", *lines), SCHEMA, "task_id").collect()}
    assert got == {str(i): 1950 + i for i in range(50)}


def test_strict(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA)
    ids = spark.createDataFrame([("a",), ("b",)], "task_id string")
    assert f.strict(df, "task_id", ids, ("v",)) is df
    for bad, word in (([("a", 1), ("a", 2)], "repeated"), ([("a", 1), (None, 2)], "without"), ([("a", 1)], "missing"), ([("a", 1), ("b", 2), ("c", 3)], "unexpected"), ([("a", None), ("b", 2)], "no v")):
        with pytest.raises(f.NotAsAgreed, match=word):
            f.strict(spark.createDataFrame(bad, SCHEMA), "task_id", ids, ("v",))


def test_documents_lists_and_tables(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for i in range(3):
        (tmp_path / "docs" / f"s{i}.json").write_text(json.dumps({"task_id": "x", "v": i}, indent=1))
    assert {(r.file, r.v) for r in f.json_documents(spark, str(tmp_path / "docs"), SCHEMA).collect()} == {(f"s{i}.json", i) for i in range(3)}
    want = [(0, "b"), (1, "a"), (2, "c")]
    for name, text in (("l", '["b", "a", "c"]'), ("o", '{"task_ids": ["b", "a", "c"]}'), ("j", '{"task_id": "b"}\n\n{"task_id": "a"}\n{"task_id": "c"}\n')):
        (tmp_path / name).write_text(text)
        assert [tuple(r) for r in f.id_list(spark, str(tmp_path / name)).orderBy("ordinal").collect()] == want
    assert f.separated(spark, put(tmp_path / "t.csv", "task_id,v", "a,1", "b,2"), SCHEMA).count() == 2
    assert f.separated(spark, put(tmp_path / "t.tsv", "a\t1", "b\t2"), SCHEMA, "\t", False).count() == 2


def test_archives_and_registry(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        for name, size in (("x/one.ifc", 10), ("two.ifc", 0)):
            info = tarfile.TarInfo(name)
            info.size = size
            tar.addfile(info, io.BytesIO(b"." * size))
    assert {(r.member, r.bytes) for r in f.archive_members(spark, str(tmp_path / "a.tar.gz")).collect()} == {("x/one.ifc", 10), ("two.ifc", 0)}
    row = f.registry(spark, put(tmp_path / "r.txt", "a", "b")).first()
    assert (row.file, row.bytes, row.lines, row.sha256) == ("r.txt", 4, 2, "911169ddaaf146aff539f58c26c489af3b892dff0fe283c1c264c65ae5aa59a2")


def test_rewriting_one_field(spark):
    lines = ['{"task_id": "a",  "t": "old \\"q\\"", "n": 1.50}', '{"task_id":"b","t":"keep"}']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    new = spark.createDataFrame([("a", 'n"e\\w\n')], "k string, x string")
    got = [r[0] for r in f.rewrite_field(df, "t", new, "task_id").collect()]
    assert sorted(got) == sorted(['{"task_id": "a",  "t": "n\\"e\\\\w\\n", "n": 1.50}', lines[1]])


def test_sinks_and_resume(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA)
    out = str(tmp_path / "out")
    f.append_pending(df, df.limit(0), "task_id", out)
    more = df.union(spark.createDataFrame([("c", 3)], SCHEMA))
    f.append_pending(more, spark.read.schema(SCHEMA).json(out), "task_id", out)
    assert sorted(r.task_id for r in spark.read.schema(SCHEMA).json(out).collect()) == ["a", "b", "c"]
    f.write_separated(df, str(tmp_path / "csv"))
    f.write_report(df, str(tmp_path / "report"))
    f.write_lines(df, str(tmp_path / "lines"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2 and spark.read.json(str(tmp_path / "report")).count() == 1
    assert {(r.metric, r.value) for r in f.metrics(df.selectExpr("count(*) as n", "sum(v) as s"), "test").collect()} == {("n", 2.0), ("s", 3.0)}
