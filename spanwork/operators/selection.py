"""Seeded, stratified selection: hash order instead of shuffles, windows instead of loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwork.session import stage_table


def hash_order(seed: int, key: str) -> Column:
    """The same order at every run and in every engine that has MD5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def depth(cells: list[str], *order: Column | str) -> Column:
    """Place of a row within its cell, from 1."""
    return F.row_number().over(Window.partitionBy(*cells).orderBy(*order))


def round_robin(df: DataFrame, cells: list[str], key: str, n: int, seed: int = 7) -> DataFrame:
    """``n`` rows, one of every cell before the second of any: deterministic for distinct keys.

    Only the first ``n`` rows of a cell can be taken, so the rank is limited before the shuffle.
    """
    ranked = df.withColumn("depth", depth(cells, hash_order(seed, key), key)).where(F.col("depth") <= n)
    return ranked.orderBy("depth", *cells, key).limit(n)


def largest_remainder(counts: DataFrame, size: str, n: int, *ties: str) -> DataFrame:
    """Quotas of ``n`` places in proportion to ``size``: whole parts, then the largest remainders.

    ``counts`` has one row per stratum.  Remainders are compared as integers, so there is no rounding.
    """
    total = F.sum(size).over(Window.partitionBy())
    share = counts.withColumn("_whole", F.floor(F.col(size) * n / total).cast("long")).withColumn("_rest", (F.col(size) * n) % total)
    left = F.lit(n) - F.sum("_whole").over(Window.partitionBy())
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("_rest"), *ties))
    return share.withColumn("quota", F.col("_whole") + (rank <= left).cast("long")).drop("_whole", "_rest")


def take_quota(df: DataFrame, quotas: DataFrame, cells: list[str], key: str, seed: int = 7) -> DataFrame:
    """The first ``quota`` rows of each cell in hash order; cells without quota give none, null cells match nothing.

    A histogram over the first three digits of the hash finds the bucket in which a cell reaches its quota; only rows up to it are
    ranked, so a cell with a third of all rows is not sorted in one task.
    """
    hashed = df.join(quotas.select(*cells, "quota"), cells).withColumn("_h", hash_order(seed, key)).withColumn("_b", F.substring("_h", 1, 3))
    upto = F.sum("_n").over(Window.partitionBy(*cells).orderBy("_b"))
    counts = hashed.groupBy(*cells, "_b", "quota").agg(F.count("*").alias("_n")).withColumn("_upto", upto)
    edge = counts.where(F.col("_upto") - F.col("_n") < F.col("quota")).groupBy(*cells).agg(F.max("_b").alias("_edge"))
    near = hashed.join(edge, cells).where(F.col("_b") <= F.col("_edge")).withColumn("depth", depth(cells, "_h", key))
    return near.where(F.col("depth") <= F.col("quota")).drop("quota", "_h", "_b", "_edge")


def global_rank(spark: SparkSession, df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Number rows from 1 in a global order: sorted by ranges, counted per range, numbered within; no task sees all rows."""
    placed = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    placed = stage_table(spark, placed, "ranked")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per range
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    return placed.join(before, "_part").withColumn(name, F.col("_before") + inner).drop("_part", "_at", "_before")


def chunked(df: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """Order by chunks: the first ``size`` rows of every group, then the next ``size`` of every group."""
    rn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("rn", rn).withColumn("chunk", F.floor((F.col("rn") - 1) / size).cast("int"))


def islands(df: DataFrame, within: list[str], order: list[str], key: Column) -> DataFrame:
    """Number of the run of equal ``key`` that a row is in."""
    by = Window.partitionBy(*within).orderBy(*order)
    new = F.when(key.eqNullSafe(F.lag(key).over(by)) & (F.row_number().over(by) > 1), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(by)).drop("_new")


def repair(kept: DataFrame, pool: DataFrame, bad: DataFrame, stratum: str, key: str, seed: int = 7) -> DataFrame:
    """Replace the ``bad`` keys of a selection by rows of the same stratum that are not in it, in hash order."""
    holes = kept.join(bad.select(key), key, "left_semi")
    holes = holes.withColumn("_n", depth([stratum], hash_order(seed, key), key)).select(stratum, F.col(key).alias("replaces"), "_n")
    spare = pool.join(kept.select(key), key, "left_anti").join(bad.select(key), key, "left_anti")
    spare = spare.withColumn("_n", depth([stratum], hash_order(seed, key), key))
    new = spare.join(holes, [stratum, "_n"]).drop("_n")
    good = kept.join(bad.select(key), key, "left_anti").withColumn("replaces", F.lit(None).cast(kept.schema[key].dataType))
    return good.unionByName(new.select(*good.columns))


def first_reason(rules: list[tuple[Column, str]]) -> Column:
    """Name of the first rule that holds; null when none does."""
    return F.coalesce(*[F.when(c, F.lit(name)) for c, name in rules])


def with_examples(df: DataFrame, reason: str, key: str, most: int = 5) -> DataFrame:
    """Count per reason and its first ``most`` keys; keys beyond them never reach the aggregate."""
    ranked = df.where(F.col(reason).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(reason).orderBy(key)))
    examples = ranked.where(F.col("_n") <= most).groupBy(reason).agg(F.sort_array(F.collect_list(key)).alias("examples"))
    return df.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("n")).join(examples, reason)
