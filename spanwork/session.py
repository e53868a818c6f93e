"""Session settings and lineage cuts.

A cluster names its shared folder in ``spark.checkpoint.dir``.  Everything here reads that setting
and falls back to a temporary folder only in plain local mode, where driver and executors are one process.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Safe everywhere: they change plans at run time only, never results.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session you are given."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("spanwork")
    settings = SETTINGS | {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(cpus)} | extra
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per session: they run in other folders, or on other machines, where it is not
    installed.  It travels as a zip of its sources; nothing is written beside them, so a read-only install will do."""
    holder = getattr(spark, "_sc", None) or spark  # a session of Spark Connect has no context
    if getattr(holder, "_spanwork_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="spanwork-zip-")  # the driver's; Spark hands the file on to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root = Path(__file__).parent
    with zipfile.ZipFile(f"{folder}/spanwork.zip", "w", zipfile.ZIP_DEFLATED) as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, str(source.relative_to(root.parent)))
    if holder is spark:
        spark.addArtifacts(f"{folder}/spanwork.zip", pyfile=True)
    else:
        holder.addPyFile(f"{folder}/spanwork.zip")
    holder._spanwork_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can read; the session's setting wins."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spanwork-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    context.setCheckpointDir(own)
    return own


def stage_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives the loss of an executor
    and keeps column pruning, which ``checkpoint()`` does not.

    The folder goes when the driver's JVM ends; ``unstage`` deletes it earlier, and ``staging`` deletes what was staged inside it.
    """
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted like a staged table."""
    path = f"{shared_dir(spark)}/spanwork-{name}-{uuid.uuid4().hex}"
    at, fs = _hadoop(spark, path)
    fs.deleteOnExit(at)
    if (open_list := _OPEN.get()) is not None:
        open_list.append(path)
    return path


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def unstage(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; tables that are not staged are left alone."""
    for df in tables:
        if path := getattr(df, "_staged_at", None):
            at, fs = _hadoop(spark, path)
            fs.delete(at, True)


_OPEN: ContextVar[list[str] | None] = ContextVar("spanwork_staging", default=None)


@contextmanager
def staging(spark: SparkSession) -> Iterator[list[str]]:
    """Within it a result is computed *and written or collected*; at its end the tables staged for it are deleted, and only those."""
    mine: list[str] = []
    token = _OPEN.set(mine)
    try:
        yield mine
    finally:
        _OPEN.reset(token)
        for path in mine:
            at, fs = _hadoop(spark, path)
            fs.delete(at, True)
