import os
import random
import shutil
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from spanwork import session
from spanwork.functions import labels
from spanwork.operators.components import connected_components
from spanwork.sources.tables import latest


def values(spark, function, words):
    df = spark.createDataFrame([(w,) for w in words], "x string")
    return [r[0] for r in df.select(function(F.col("x"))).collect()]


def test_labels(spark):
    assert values(spark, labels.operation, [" Update", "upd.", "CRE", "creation", "del", None, "", "x"]) == ["update", "update", "create", "create", "delete", None, None, None]
    assert values(spark, labels.category, ["topo", "DIR", "spa.", None]) == ["topological", "direct", "spatial", None]
    assert values(spark, labels.split, ["training", "VAL", "valid", " test", "dev", None, "?"]) == ["train", "validation", "validation", "test", "validation", None, None]
    assert values(spark, labels.ifc_version, ["IFC 2x3", "2x3", "IFC4_ADD2_TC1", "IFC 4.3", "ifc4x3", "IFC4X3_ADD2", "IFC2X3_TC1", "IFC5", None]) == ["IFC2X3", "IFC2X3", "IFC4", "IFC4X3", "IFC4X3", "IFC4X3", "IFC2X3", None, None]
    assert values(spark, labels.code, ["S-000043", " s000043 ", "Bld 002044", "BLD000000", "bld-0", "anon", "n/a", "?", "-", None]) == ["S000043", "S000043", "BLD002044"] + [None] * 7
    same = ["corpus/civic/M1/arch.IFC", r"D:\store\CORPUS\CIVIC\M1\ARCH.IFC", "file:///srv/store/corpus//civic/M1//arch.ifc", "./x/M1/./arch.ifc", " M1/arch.ifc "]
    assert values(spark, labels.model_key, [*same, "model.ifc", "tbd", "", None]) == ["m1/arch.ifc"] * 5 + [None] * 4


def test_latest(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", 2), (2, None, 1), (None, "x", 9)], "k long, v string, at int")
    assert {(r.k, r.v) for r in latest(df, "k", "at").collect()} == {(1, "b"), (2, None)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5400)] + [(9, 9), (7777, 7777)]
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*edges, (None, 1), (2, None)], "a long, b long")
    assert {(r.node, r.component) for r in connected_components(spark, df).collect()} == {(n, root(n)) for n in parent}
    assert connected_components(spark, df.limit(0)).count() == 0


def test_staging_deletes_its_own_tables_only(spark):
    kept = session.stage_table(spark, spark.range(3), "kept")
    with session.staging(spark) as mine:
        assert session.stage_table(spark, spark.range(5), "gone").count() == 5
    assert len(mine) == 1 and not os.path.exists(mine[0].removeprefix("file:"))
    assert kept.count() == 3
    session.unstage(spark, kept, spark.range(1))
    assert not os.path.exists(kept._staged_at.removeprefix("file:"))


def test_package_travels_without_writes_beside_it(spark, tmp_path):
    code = "import sys; sys.dont_write_bytecode = True; from spanwork.session import local_session; local_session(1).stop()"
    shutil.copytree(Path(session.__file__).parent, tmp_path / "spanwork", ignore=shutil.ignore_patterns("__pycache__"))
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, capture_output=True)
    assert not list(tmp_path.rglob("__pycache__"))
