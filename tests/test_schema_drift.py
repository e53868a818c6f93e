import json

from spanwork.operators.schema_drift import compare, consistent_table, name_likeness, profile, schema_drift

SCHEMA = "feed string, file_id long, file_seq int, line_no int, payload string, path string"


def lines(spark, files):
    rows = []
    for feed, file_id, seq, records in files:
        rows += [(feed, file_id, seq, n, r if isinstance(r, str) or r is None else json.dumps(r), "x") for n, r in enumerate(records)]
    return spark.createDataFrame(rows, SCHEMA)


def record(i, **more):
    return {"id": f"T-{i:04d}", "operation": ("create", "update", "delete")[i % 3], "n": i, "target": {"entity_type": ("IfcWall", "IfcDoor")[i % 2], "guids": ["2ep$$769slfzBejlZDr4OB"]}, **more}


def renamed(r):
    t = r.pop("target")
    return {**r, "edit_target": t}


def test_every_kind_of_change(spark):
    one = [record(i) for i in range(12)]
    two = [{**record(i), "extra": None} for i in range(12)] + [one[0], "{cut", "[1]", None, ""]
    three = [renamed({k: v for k, v in record(i).items() if k != "n"}) for i in range(12)]
    four = [{**renamed({k: v for k, v in record(i).items() if k not in ("n", "operation")}), "op": record(i)["operation"], "new": {"a": 1}} for i in range(12)]
    five = [{**r, "id": i, "new": "text"} for i, r in enumerate(four)]
    files = [("f", 5, 9, five), ("f", 1, 1, one), ("f", 2, 2, two), ("f", 3, 4, three), ("f", 4, 5, four), ("g", 6, 1, one), ("f", 7, 3, ["{broken", None])]
    drift = schema_drift(spark, lines(spark, files))
    got = {(r.file_id, r.field_path, r.change_kind) for r in drift.changes.collect()}
    assert got == {
        (2, "extra", "added"),
        (3, "extra", "removed"), (3, "n", "removed"), (3, "edit_target", "renamed"),
        (4, "op", "renamed"), (4, "new", "added"),
        (5, "id", "retyped"), (5, "new", "retyped"),
    }
    assert schema_drift(spark, lines(spark, files + files)).changes.count() == len(got)


def test_consistent_table(spark):
    files = [("f", 1, 1, [record(i) for i in range(6)]), ("f", 2, 2, [renamed(record(i)) for i in range(20)] + ["{cut"]), ("f", 3, 3, [{**renamed(record(i)), "n": str(i)} for i in range(6)])]
    source = lines(spark, files)
    rows = consistent_table(spark, source, schema_drift(spark, source))
    assert {"edit_target_entity_type", "edit_target_guids", "id", "n", "operation", "unfit"} <= set(rows.columns)
    got = rows.collect()
    assert len(got) == 32 and all(r.edit_target_entity_type in ("IfcWall", "IfcDoor") for r in got)
    assert {r.n for r in got if r.file_id == 3} == {str(i) for i in range(6)} and all(r.unfit is None for r in got)
    assert consistent_table(spark, source.union(source), schema_drift(spark, source)).count() == 32


def test_empty_and_nulls(spark):
    empty = lines(spark, [])
    assert schema_drift(spark, empty).changes.count() == 0
    nulls = spark.createDataFrame([(None, 1, 1, 1, "{}", "x"), ("f", None, 1, 1, "{}", "x"), ("f", 1, 1, 1, "{}", "x"), ("f", 2, 2, 1, '{"a": null}', "x"), ("f", 3, 3, 1, '{"a": 1}', "x")], SCHEMA)
    assert {tuple(r)[1:4] for r in schema_drift(spark, nulls).changes.collect()} == {(2, "a", "added")}


def test_names_and_unlike_contents():
    assert name_likeness("op", "operation") == name_likeness("kind", "edit_kind") * 1.5 == 1.0
    assert name_likeness("families", "family_tags") > 0.6 and name_likeness("wave", "seed") == 0

    def graph(records):
        out: dict = {}
        for r in records:
            for p, f in profile(r):
                out.setdefault(p, {}).setdefault(f, 0.0)
                out[p][f] += 1
        return out

    a = graph([{"k": i, "size": 0.5} for i in range(9)])
    b = graph([{"k": i, "label": "a word"} for i in range(9)])
    assert compare(a, b) == [("label", "added", None), ("size", "removed", "size")]
