"""File sources and sinks: lines of JSON, tables of text, lists of ids, archives, registries."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class NotAsAgreed(ValueError):
    """An input breaks its contract."""


def json_lines(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """Lines of JSON, compressed or not; blank lines are skipped, a line that cannot be read is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, value): places grow along a file whatever its splits."""
    place = F.struct(F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(F.input_file_name().alias("file"), place.alias("place"), "value").where(F.trim("value") != "")


def latest_lines(spark: SparkSession, path: str, schema: StructType | str, key: str) -> DataFrame:
    """Keyed lines of one journal of which a later one replaces an earlier one."""
    rows = numbered_lines(spark, path).select("place", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    return rows.groupBy(F.col(f"r.{key}").alias("_key")).agg(F.max_by("r", "place").alias("r")).select("r.*")


def strict(df: DataFrame, key: str, expected: DataFrame | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """``df`` itself, after checks that raise: keys present once each, exactly the expected ones, required columns filled."""
    faults = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col(key).isNull()).alias("without"))
    found = faults.first().asDict() | df.agg(*[F.count_if(F.col(c).isNull()).alias(f"no {c}") for c in required] or [F.lit(0).alias("none")]).first().asDict()
    if expected is not None:
        ids = expected.select(key).distinct()
        found["missing"] = ids.join(df, key, "left_anti").count()
        found["unexpected"] = df.join(ids, key, "left_anti").count()
    bad = {k: v for k, v in found.items() if v}
    if bad:
        raise NotAsAgreed(", ".join(f"{k}: {v}" for k, v in bad.items()))
    return df


def json_documents(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """One JSON document per file, with the file's name."""
    return spark.read.schema(schema).option("multiLine", True).json(folder).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def separated(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",", header: bool = True) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep=sep, header=header, mode="FAILFAST")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, id) of a JSON list of ids, of an object with ``task_ids``, or of lines of JSON with ``task_id``, in file order."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    lists = F.coalesce(
        F.when(F.startswith("value", F.lit("[")), F.from_json("value", "array<string>")),
        F.from_json(F.get_json_object("value", "$.task_ids"), "array<string>"),
        F.transform(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""), lambda x: F.get_json_object(x, "$.task_id")),
    )
    return whole.select(F.posexplode(lists).alias("ordinal", "id"))


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, bytes) of tar archives, compressed or not."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    members = [(name, m.name, m.size) for m in tar if m.isfile()]
                columns = list(zip(*members)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["archive", "member", "bytes"])

    return files.mapInArrow(run, "archive string, member string, bytes long")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, lines, sha256) of input files."""
    files = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "UTF-8")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("lines"), F.sha2("content", 256).alias("sha256"))


def rewrite_field(lines: DataFrame, field: str, new: DataFrame, key: str) -> DataFrame:
    """Lines of JSON (column value) with one text field replaced where ``new`` (key, text) has one; all other bytes stay.

    A rewritten line that does not read back as the old one but for the field is an error.
    """
    rows = lines.select("value", F.get_json_object("value", f"$.{key}").alias(key)).join(new.toDF(key, "_text"), key, "left")
    pattern = rf'("{field}"\s*:\s*)"(?:[^"\\]|\\.)*"'
    quoted = F.to_json(F.array("_text"))
    literal = F.substring(quoted, 2, 1_000_000_000)
    literal = F.expr("substr(_q, 2, length(_q) - 2)")
    rows = rows.withColumn("_q", quoted).withColumn("_lit", literal)
    put = F.concat(F.regexp_extract("value", rf"(?s)^(.*?{pattern.split('(?:')[0][:-1]})", 1), F.col("_lit"), F.regexp_replace("value", rf"(?s)^.*?{pattern}", ""))
    rows = rows.withColumn("_new", F.when(F.col("_text").isNull(), F.col("value")).otherwise(put))
    same = F.get_json_object("_new", f"$.{field}") == F.col("_text")
    checked = F.when(F.col("_text").isNull() | same, F.col("_new")).otherwise(F.raise_error(F.concat(F.lit("not rewritten: "), F.col(key))))
    return rows.select(checked.alias("value"))


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_report(df: DataFrame, path: str) -> None:
    """One row as one JSON document."""
    df.limit(1).coalesce(1).write.mode("overwrite").json(path)


def write_separated(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def append_pending(pending: DataFrame, done: DataFrame, key: str, path: str) -> None:
    """Append what is not done yet: a job that is started again goes on where it stopped."""
    pending.join(done.select(key), key, "left_anti").write.mode("append").json(path)


def metrics(row: DataFrame, source: str) -> DataFrame:
    """One row of figures as (metric, value, source)."""
    names = [c for c in row.columns]
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in names)
    return row.select(F.expr(f"stack({len(names)}, {pairs}) as (metric, value)"), F.lit(source).alias("source"))
