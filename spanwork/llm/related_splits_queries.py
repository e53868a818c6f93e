"""Problem 3: practitioner requests that share a writer, a source model or a building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwork import session
from spanwork.functions import labels
from spanwork.llm.related_splits import Components, assign_related, assignments
from spanwork.sources.tables import latest, table


def shares(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Proportions of the splits over all runs; accepted tasks that went to neither train nor validation are test.  Without any
    run, eight to one to one."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    rest = F.greatest(F.lit(0), n("n_accepted") - n("n_train") - n("n_validation"))
    r = table(spark, sf_dir, "funnel").agg(F.sum(n("n_train")).alias("train"), F.sum(n("n_validation")).alias("validation"), F.sum(rest).alias("test")).first()
    counts = {k: v or 0 for k, v in r.asDict().items()}
    total = sum(counts.values())
    return {k: v / total for k, v in counts.items()} if total else {"train": 0.8, "validation": 0.1, "test": 0.1}


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "request_props"), "task_id", "loaded_at", columns=["writer", "building_id", "input_ifc", "split", "loaded_at"])


def _links() -> dict[str, Column]:
    return {
        "writer": labels.code(F.col("writer")),
        "building": labels.code(F.col("building_id")),
        "model": labels.model_key(F.col("input_ifc")),
    }


def related(spark: SparkSession, sf_dir: str, resolve: bool = False) -> Components:
    return assign_related(spark, _props(spark, sf_dir), "task_id", _links(), labels.split(F.col("split")), shares(spark, sf_dir), resolve=resolve)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets that the present split tears apart: labels of different splits meet in one component."""
    rows = assignments(spark, related(spark, sf_dir))
    return rows.where("status = 'quarantined'").select(F.col("record").alias("task_id"))


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignments(spark, related(spark, sf_dir)).withColumnRenamed("record", "task_id")


def _with_moves(rows: DataFrame, props: DataFrame) -> DataFrame:
    """``rows`` with the present split (``was``) and whether the record leaves it."""
    was = props.select("task_id", labels.split(F.col("split")).alias("was"))
    return rows.join(was, "task_id").withColumn("moved", F.coalesce(F.col("was") != F.col("split"), F.lit(False)))


def p3_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split for every request: sets with one present split keep it, torn sets and those without one fill the deficits."""
    rows = assignments(spark, related(spark, sf_dir, resolve=True)).select(F.col("record").alias("task_id"), "component", "split")
    return _with_moves(rows, _props(spark, sf_dir))


def p3_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in two batches by time of loading, the later half through the persisted state of the earlier one;
    ``first_split`` is what a request of the first batch had after it."""
    props, wanted = session.stage_table(spark, _props(spark, sf_dir), "props"), shares(spark, sf_dir)
    middle = props.agg(F.percentile_approx("loaded_at", 0.5).alias("at")).first()["at"]
    late = F.coalesce(F.col("loaded_at") > F.lit(middle and str(middle)).cast(props.schema["loaded_at"].dataType), F.lit(False))
    place = lambda rows, before: assign_related(spark, rows, "task_id", _links(), labels.split(F.col("split")), wanted, before, resolve=True)
    state = place(props.where(~late), None)
    folder = session.new_folder(spark, "components")
    state.save(folder)
    state = Components.load(spark, folder)
    first = assignments(spark, state).select(F.col("record").alias("task_id"), F.col("split").alias("first_split"))
    rows = assignments(spark, place(props.where(late), state)).select(F.col("record").alias("task_id"), "component", "split")
    return _with_moves(rows.join(first, "task_id", "left"), props)


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split: requests wanted by the proportions, held by sets that keep their split, reached, and the gap between wanted and
    reached.  Without requests there are no rows."""
    wanted = spark.createDataFrame(sorted(shares(spark, sf_dir).items()), "split string, share double")
    rows = session.stage_table(spark, p3_assigned(spark, sf_dir), "assigned")
    total = rows.count()
    reached = rows.groupBy("split").agg(F.count("*").alias("reached"), F.count_if("moved").alias("moved_in"), F.countDistinct("component").alias("n_sets"))
    wanted = wanted.where(F.lit(total > 0))
    return wanted.join(reached, "split", "left").fillna(0).withColumn("wanted", F.col("share") * total).withColumn("gap", F.col("wanted") - F.col("reached"))


QUERIES = {"p3_report": p3_report, "p3_found": p3_found, "p3_splits": p3_splits, "p3_assigned": p3_assigned, "p3_batches": p3_batches}
SQL = {
    "p3_found": r"""
WITH RECURSIVE r AS (
  SELECT task_id, arg_max(struct_pack(w := writer, b := building_id, i := input_ifc, s := split), loaded_at) AS x FROM request_props GROUP BY task_id
), c AS (
  SELECT task_id, CASE WHEN regexp_replace(lower(trim(x.s)), '[^a-z]', '', 'g') LIKE 'tr%' THEN 1 WHEN lower(trim(x.s)) LIKE 'val%' THEN 2 WHEN lower(trim(x.s)) LIKE 'te%' THEN 3 END AS s,
    upper(regexp_replace(lower(x.w), '[^a-z0-9]', '', 'g')) AS w, upper(regexp_replace(lower(x.b), '[^a-z0-9]', '', 'g')) AS b,
    regexp_extract(regexp_replace(lower(trim(x.i)), '[\\/]+(\.[\\/]+)*', '/', 'g'), '([^/:]+/[^/:]+\.[a-z0-9]+)$', 1) AS m FROM r
), e AS (
  SELECT task_id, 'w' || w AS v FROM c WHERE regexp_matches(w, '[1-9]') UNION ALL SELECT task_id, 'b' || b FROM c WHERE regexp_matches(b, '[1-9]')
  UNION ALL SELECT task_id, 'm' || m FROM c WHERE m <> ''
), l AS (SELECT DISTINCT a.task_id AS x, b.task_id AS y FROM e a JOIN e b USING (v)),
reach AS (SELECT task_id AS x, task_id AS y FROM c UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x)
SELECT x AS task_id FROM reach JOIN c ON c.task_id = reach.y GROUP BY x HAVING count(DISTINCT s) > 1
""",
}
