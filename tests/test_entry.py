import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]
CODE = """
import sys; sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as entry
rows = [("f", 1, 1, '{"a": 1}'), ("f", 2, 2, '{"b": "word"}')]
spark.createDataFrame(rows, "feed string, file_id long, file_seq int, payload string").write.parquet(sys.argv[2] + "/raw_record.parquet")
print("ROWS", entry.queries()["p5_found"](spark, sys.argv[2]).count())
"""


def test_workers_find_the_package_from_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", CODE, str(ROOT), str(tmp_path / "data")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS 2" in run.stdout, run.stderr[-2000:]


def test_every_oracle_has_a_query():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
