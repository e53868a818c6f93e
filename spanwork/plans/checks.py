"""Queries that join, check and compare: lookups, contamination, ordering, maps, tags, error distributions."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from spanwork.functions import labels, messages, stats, text
from spanwork.operators import sets
from spanwork.operators.selection import hash_order
from spanwork.plans.base import BUILDING, DONE, RECORDS, RESULTS, SPLIT, TASKS, completed, records, results, tasks
from spanwork.plans.graphs import BOXES, _boxes
from spanwork.plans.selecting import POOL, pool
from spanwork.plans.texts import REQUESTS, _requests
from spanwork.sources.tables import latest, table


def j1_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and their tasks: verdicts per operation and edit kind."""
    kinds = table(spark, sf_dir, "task").groupBy("task_id").agg(F.max_by("edit_kind", F.struct("loaded_at", "rec_id")).alias("edit_kind"))
    return results(spark, sf_dir).join(kinds, "task_id").groupBy("edit_kind").agg(F.count("*").alias("n"), F.count_if(completed()).alias("n_done"))


def j3_left_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that documents talk about, with the number of requests on them, 0 without any."""
    model = F.split_part(labels.model_key(F.col("input_ifc")), F.lit("/"), F.lit(1)).alias("key")
    asked = table(spark, sf_dir, "request_props").select("task_id", model).distinct().where("key is not null").groupBy("key").agg(F.count("*").alias("requests"))
    docs = table(spark, sf_dir, "documents").where("model_key is not null").groupBy(F.lower("model_key").alias("key")).agg(F.count("*").alias("documents"))
    return docs.join(asked, "key", "left").select("key", "documents", F.coalesce("requests", F.lit(0)).alias("requests"))


def j7_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests under the id of the task they reword: the writer's suffix is cut off."""
    base = F.regexp_replace("task_id", "-S[0-9]+(-[0-9]+)?$", "")
    r = latest(table(spark, sf_dir, "request_props"), "task_id", "loaded_at", columns=["base_task_id"])
    return r.groupBy((base == F.col("base_task_id")).alias("agrees")).agg(F.count("*").alias("n"))


def j11_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings whose evaluation records name target elements that train records name too: shared elements and up to five of them."""
    e = records(spark, sf_dir, "split", "building_id", "target").select(labels.split(F.col("split")).alias("split"), labels.code(F.col("building_id")).alias("building"), F.explode("target.guids").alias("guid"))
    both = e.where("building is not null and split is not null").groupBy("building", "guid").agg(F.max((F.col("split") == "train").cast("int")).alias("a"), F.max((F.col("split") != "train").cast("int")).alias("b")).where("a = 1 and b = 1")
    ranked = both.withColumn("rn", F.row_number().over(Window.partitionBy("building").orderBy("guid")))
    return ranked.groupBy("building").agg(F.count("*").alias("shared"), F.sort_array(F.collect_list(F.when(F.col("rn") <= 5, F.col("guid")))).alias("examples"))


def a11_union_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct task ids over all tables, and in how many tables each stands."""
    ids = sets.union_all(*[table(spark, sf_dir, t).select("task_id", F.lit(t).alias("t")) for t in ("task", "task_result", "outcome", "request_props")]).where("task_id is not null").distinct()
    return ids.groupBy("task_id").agg(F.count("*").alias("c")).groupBy(F.col("c").alias("tables")).agg(F.count("*").alias("ids"))


def a12_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool(spark, sf_dir).groupBy("operation").agg(F.count_distinct("building").alias("buildings"), F.count_distinct("model").alias("models"), F.count_distinct("operation", "category").alias("cells"))


def a24_share_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many deletions to leave out so that they are a tenth of the pool: n solves (d - n) / (total - n) = 1/10."""
    p = pool(spark, sf_dir).agg(F.count_if(F.col("operation") == "delete").alias("d"), F.count("*").alias("total"))
    return p.select("d", "total", F.greatest(F.lit(0), F.ceil((10 * F.col("d") - F.col("total")) / 9.0)).cast("long").alias("leave_out"))


def o1_mixed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred largest orders by price in whole thousands downwards, then date and key upwards."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.floor(F.col("o_totalprice") / 1000).alias("k"))
    return o.orderBy(F.desc("k"), "o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "k")


def o4_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of raw files in the order of files and lines, numbered through per feed."""
    r = table(spark, sf_dir, "raw_record").select("feed", "file_seq", "file_id", "line_no").distinct()
    return r.withColumn("ordinal", F.row_number().over(Window.partitionBy("feed").orderBy("file_seq", "file_id", "line_no")))


def o6_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty train records of a seeded shuffle."""
    return pool(spark, sf_dir).orderBy(hash_order(7, "rec_id"), "rec_id").limit(50).select("rec_id")


def u1_union_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that only one side has come out null."""
    a = table(spark, sf_dir, "outcome").select("task_id", "stage", "reason")
    b = table(spark, sf_dir, "task_result").select("task_id", "stop_reason")
    return sets.union_all(a, b).groupBy("stage", "stop_reason").agg(F.count("*").alias("n"))


def u2_set_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in both, in the first alone and in the second alone, for every two adapters."""
    ids = results(spark, sf_dir).select("adapter", "task_id")
    names = ids.select("adapter").distinct()
    pairs = names.toDF("a").join(names.toDF("b"), F.col("a") < F.col("b"))  # a handful of adapters
    size = ids.groupBy("adapter").agg(F.count("*").alias("n"))
    both = ids.toDF("a", "task_id").join(ids.toDF("b", "task_id"), "task_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    rows = pairs.join(both, ["a", "b"], "left").join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
    c = F.coalesce("both", F.lit(0))
    return rows.select("a", "b", c.alias("both"), (F.col("na") - c).alias("only_a"), (F.col("nb") - c).alias("only_b"))


def f4_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as code: tidied lines, counted by their number."""
    n = F.size(F.split(messages.tidy_code(F.col("text")), "\n"))
    return _requests(spark, sf_dir).groupBy(n.alias("lines")).agg(F.count("*").alias("n"))


def f9_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in the parameters of an edit, read as a Python literal: no relational form, so an Arrow kernel."""
    @F.pandas_udf(IntegerType())
    def numbers(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def count(source: str | None) -> int | None:
            if source is None:
                return None
            try:
                tree = ast.parse(source.replace("null", "None").replace("true", "True").replace("false", "False"), mode="eval")
            except (SyntaxError, ValueError):
                return -1
            return sum(isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) and not isinstance(n.value, bool) for n in ast.walk(tree))

        for s in parts:
            yield s.map(count).astype("Int32")

    return table(spark, sf_dir, "task").select(numbers("edit_params").alias("numbers")).groupBy("numbers").agg(F.count("*").alias("n"))


def f16_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with a synonym chosen by their id: one of three verbs for the first."""
    verbs = F.array(F.lit("Delete"), F.lit("Erase"), F.lit("Take away"))
    pick = F.element_at(verbs, (F.col("rec_id") % 3 + 1).cast("int"))
    rows = _requests(spark, sf_dir).where(F.startswith("text", F.lit("Remove ")))
    return rows.select("rec_id", F.md5(F.concat(pick, F.substring("text", 7, 1_000_000))).alias("key"))


def f18_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths in requests by unit, and their sum in millimetres."""
    found = F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]+(?:\.[0-9]+)? ?(?:mm|cm|metres|m)\b"), F.lit(0))).alias("length")
    rows = _requests(spark, sf_dir).select(found).select(F.regexp_extract("length", "([a-z]+)$", 1).alias("unit"), F.regexp_extract("length", r"^([0-9.]+)", 1).cast("decimal(20,4)").alias("value"))
    scale = F.when(F.col("unit") == "mm", 1).when(F.col("unit") == "cm", 10).otherwise(1000)
    return rows.groupBy("unit").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * scale)).cast("long").alias("mm"))


def f20_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential score of a price ratio, by bands; what is no number scores 0."""
    ratio = F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0)) / 1000
    score = F.coalesce(F.when(~F.isnan(ratio), F.exp(-ratio)), F.lit(0.0))
    return table(spark, sf_dir, "lineitem").groupBy(F.floor(score * 10).alias("band")).agg(F.count("*").alias("n"))


def m3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of prompt and instruction where a record has both, in percent."""
    rows = records(spark, sf_dir, "prompt", "instruction").where("prompt is not null and instruction is not null")
    a, b = (F.array_distinct(text.words(F.col(c))) for c in ("prompt", "instruction"))
    return rows.select(F.floor(text.jaccard(a, b) * 100).alias("percent")).groupBy("percent").agg(F.count("*").alias("n"))


def m4_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "task").groupBy(F.array_join(F.array_distinct("families"), "|").alias("kept"), F.array_join(F.array_sort(F.array_distinct("families")), "|").alias("sorted")).agg(F.count("*").alias("n"))


def m6_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested fields as a map of dotted names, and how often each is filled."""
    pairs = F.map_from_arrays(
        F.array(*[F.lit(n) for n in ("target.entity_type", "clarification.slot", "clarification.question", "verification.gold_sha256")]),
        F.array(F.col("target.entity_type"), F.col("clarification.slot"), F.col("clarification.question"), F.col("verification.gold_sha256")),
    )
    return table(spark, sf_dir, "task").select(F.explode(pairs).alias("name", "value")).groupBy("name").agg(F.count("value").alias("filled"), F.count_distinct("value").alias("values"))


def t2_numbers_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures in the replies of runs that the request does not hold: how many runs bring how many."""
    n = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[0-9]+(?:[.][0-9]+)?"), F.lit(0)))
    r = results(spark, sf_dir).where("reply is not null").select("adapter", "task_id", n(F.col("reply")).alias("said"))
    asked = _requests(spark, sf_dir).join(table(spark, sf_dir, "task").select("rec_id", "task_id").distinct(), "rec_id").where("task_id is not null")
    asked = asked.select("task_id", F.explode(n(F.col("text"))).alias("x")).distinct().groupBy("task_id").agg(F.collect_set("x").alias("given"))
    new = F.size(F.array_except("said", F.coalesce("given", F.array().cast("array<string>"))))
    return r.join(asked, "task_id", "left").groupBy("adapter", new.alias("new_figures")).agg(F.count("*").alias("n"))


def t18_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of sessions rebuilt from their events: rounds, errors, last type."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("rounds"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


def g8_missing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that a supplier sold in finished orders and never in open ones, per supplier."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count_if(F.col("l_linestatus") == "F").alias("f"), F.count_if(F.col("l_linestatus") == "O").alias("o"))
    return lines.where("f > 0 and o = 0").groupBy("l_suppkey").agg(F.count("*").alias("missing"))


def g11_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Along x, the gap of each box to the next one of all boxes, in bands."""
    b = _boxes(spark, sf_dir).withColumn("band", F.floor(F.col("y0") / 50))
    nxt = F.lead("x0").over(Window.partitionBy("band").orderBy("x0", "id"))
    return b.select("band", F.greatest(F.lit(0), nxt - F.col("x1")).alias("gap")).where("gap is not null").groupBy("band").agg(F.count("*").alias("n"), F.sum("gap").cast("long").alias("gap"))


def g20_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-delivered records: is the new delivery the same but for its time?"""
    t = table(spark, sf_dir, "task").where("rec_id is not null").select("rec_id", F.sha2(F.to_json(F.struct("task_id", "prompt", "instruction", "split", "target")), 256).alias("signature"))
    d = t.groupBy("rec_id").agg(F.count("*").alias("c"), F.count_distinct("signature").alias("s")).where("c > 1")
    return d.groupBy((F.col("s") == 1).alias("same")).agg(F.count("*").alias("n"))


def g28_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions of records as tags."""
    tags = F.array_compact(F.array(
        F.when(F.size("target.guids") == 0, F.lit("no_target")), F.when(F.size("target.guids") > 2, F.lit("many_targets")), F.when(F.col("clarification").isNotNull(), F.lit("asks")),
        F.when(F.col("verification.null_edit_score") > 0.5, F.lit("high_floor")), F.when(F.col("prompt").isNull(), F.lit("instruction_only")),
    ))
    return records(spark, sf_dir, "target", "clarification", "verification", "prompt").select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def x15_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that were repeated: did the verdict flip?"""
    r = table(spark, sf_dir, "task_result").where("adapter is not null and task_id is not null").withColumn("done", completed())
    d = r.groupBy("adapter", "task_id").agg(F.count("*").alias("c"), F.count_distinct("done").alias("verdicts")).where("c > 1")
    return d.groupBy("adapter").agg(F.count("*").alias("repeated"), F.count_if(F.col("verdicts") > 1).alias("flipped"))


def x21_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of what is missing to a perfect score, per verdict and operation."""
    miss = F.floor((1 - F.col("score.final")) * 1000)
    rows = results(spark, sf_dir).where("score.final is not null").join(tasks(spark, sf_dir), "task_id").withColumn("done", completed())
    return rows.groupBy("done", "operation").agg(F.count("*").alias("n"), F.percentile(miss, F.lit(0.5)).alias("median"), F.percentile(miss, F.lit(0.95)).alias("p95"), F.max(miss).alias("most"))


def x3_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wilson interval of completion per operation over all adapters."""
    rows = results(spark, sf_dir).join(tasks(spark, sf_dir), "task_id").groupBy("operation").agg(F.count("*").alias("n"), F.count_if(completed()).alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"), 1.96)
    return rows.select("operation", "n", "k", low.alias("low"), high.alias("high"))


_N = "list_distinct(regexp_extract_all({0}, '[0-9]+(?:[.][0-9]+)?'))"
QUERIES = {
    "ref_a11_union_of_ids": a11_union_of_ids, "ref_a12_distinct": a12_distinct, "ref_a24_share_target": a24_share_target, "ref_f4_code": f4_code, "ref_f9_parameters": f9_parameters, "ref_f16_rewrite": f16_rewrite, "ref_f18_units": f18_units, "ref_f20_exp": f20_exp,
    "ref_g8_missing_pairs": g8_missing_pairs, "ref_g11_gaps": g11_gaps, "ref_g20_unchanged": g20_unchanged, "ref_g28_tags": g28_tags,
    "ref_j1_inner": j1_inner, "ref_j3_left_default": j3_left_default, "ref_j7_mapping": j7_mapping, "ref_j11_contamination": j11_contamination, "ref_m3_jaccard": m3_jaccard, "ref_m4_ordered_distinct": m4_ordered_distinct, "ref_m6_flatten": m6_flatten,
    "ref_o1_mixed_order": o1_mixed_order, "ref_o4_file_order": o4_file_order, "ref_o6_shuffle": o6_shuffle, "ref_t2_numbers_observed": t2_numbers_observed, "ref_t18_rebuild": t18_rebuild, "ref_u1_union_runs": u1_union_runs, "ref_u2_set_relations": u2_set_relations,
    "ref_x4_wilson": x3_direction, "ref_x15_stability": x15_stability, "ref_x21_errors": x21_errors,
}
SQL = {
    "ref_a11_union_of_ids": "WITH i AS (SELECT task_id, 1 AS t FROM task UNION SELECT task_id, 2 FROM task_result UNION SELECT task_id, 3 FROM outcome UNION SELECT task_id, 4 FROM request_props), c AS (SELECT task_id, count(*) AS tables FROM i WHERE task_id IS NOT NULL GROUP BY task_id) SELECT tables, count(*) AS ids FROM c GROUP BY tables",
    "ref_a12_distinct": f"WITH {POOL} SELECT operation, count(DISTINCT building) AS buildings, count(DISTINCT model) AS models, count(DISTINCT CASE WHEN operation IS NOT NULL THEN category END) AS cells FROM p GROUP BY operation",
    "ref_a24_share_target": f"WITH {POOL} SELECT count(*) FILTER (operation = 'delete') AS d, count(*) AS total, greatest(0, ceil((10 * count(*) FILTER (operation = 'delete') - count(*)) / 9.0::DOUBLE))::BIGINT AS leave_out FROM p",
    "ref_f16_rewrite": f"WITH {REQUESTS} SELECT rec_id, md5(['Delete', 'Erase', 'Take away'][rec_id % 3 + 1] || text[7:]) AS key FROM q WHERE starts_with(text, 'Remove ')",
    "ref_m4_ordered_distinct": "SELECT array_to_string(list_filter(families, lambda x, i: list_position(families, x) = i), '|') AS kept, array_to_string(list_sort(list_distinct(families)), '|') AS sorted, count(*) AS n FROM task GROUP BY ALL",
    "ref_g20_unchanged": """WITH d AS (SELECT rec_id, count(*) AS c, count(DISTINCT struct_pack(a := task_id, b := prompt, c := instruction, d := split, e := target)) AS s FROM task WHERE rec_id IS NOT NULL GROUP BY rec_id HAVING count(*) > 1)
    SELECT s = 1 AS same, count(*) AS n FROM d GROUP BY ALL""",
    "ref_f4_code": f"WITH {REQUESTS} SELECT greatest(1, len(list_filter(string_split(text, chr(10)), lambda x: length(rtrim(x)) > 0)))::INT AS lines, count(*) AS n FROM q GROUP BY ALL",
    "ref_f18_units": f"WITH {REQUESTS}, l AS (SELECT unnest(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)? ?(?:mm|cm|metres|m)\\b')) AS l FROM q), u AS (SELECT regexp_extract(l, '([a-z]+)$', 1) AS unit, regexp_extract(l, '^([0-9.]+)', 1)::DECIMAL(20,4) AS v FROM l) SELECT unit, count(*) AS n, sum(floor(v * CASE unit WHEN 'mm' THEN 1 WHEN 'cm' THEN 10 ELSE 1000 END))::BIGINT AS mm FROM u GROUP BY unit",
    "ref_f20_exp": "SELECT floor(coalesce(exp(-(l_extendedprice / nullif(l_quantity, 0) / 1000)), 0) * 10)::BIGINT AS band, count(*) AS n FROM lineitem GROUP BY ALL",
    "ref_g8_missing_pairs": "WITH p AS (SELECT l_suppkey, l_partkey, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY ALL) SELECT l_suppkey, count(*) AS missing FROM p WHERE f > 0 AND o = 0 GROUP BY l_suppkey",
    "ref_g11_gaps": f"WITH {BOXES}, n AS (SELECT floor(y0 / 50)::BIGINT AS band, greatest(0, lead(x0) OVER (PARTITION BY floor(y0 / 50) ORDER BY x0, id) - x1) AS gap, lead(x0) OVER (PARTITION BY floor(y0 / 50) ORDER BY x0, id) AS nx FROM bx) SELECT band, count(*) AS n, sum(gap)::BIGINT AS gap FROM n WHERE gap IS NOT NULL GROUP BY band",
    "ref_g28_tags": f"""WITH {RECORDS}, g AS (SELECT unnest(list_filter([CASE WHEN len(target.guids) = 0 THEN 'no_target' END, CASE WHEN len(target.guids) > 2 THEN 'many_targets' END, CASE WHEN clarification IS NOT NULL THEN 'asks' END, CASE WHEN verification.null_edit_score > 0.5 THEN 'high_floor' END, CASE WHEN prompt IS NULL THEN 'instruction_only' END], lambda x: x IS NOT NULL)) AS tag FROM t) SELECT tag, count(*) AS n FROM g GROUP BY tag""",
    "ref_j1_inner": f"WITH {RESULTS}, k AS (SELECT task_id, arg_max(edit_kind, struct_pack(l := loaded_at, r := rec_id)) AS edit_kind FROM task WHERE task_id IS NOT NULL GROUP BY task_id) SELECT edit_kind, count(*) AS n, count(*) FILTER ({DONE}) AS n_done FROM r JOIN k USING (task_id) GROUP BY edit_kind",
    "ref_j3_left_default": r"""WITH m AS (SELECT DISTINCT task_id, split_part(nullif(regexp_extract(regexp_replace(lower(trim(input_ifc)), '[\\/]+(\.[\\/]+)*', '/', 'g'), '([^/:]+/[^/:]+\.[a-z0-9]+)$', 1), ''), '/', 1) AS key FROM request_props), a AS (SELECT key, count(*) AS requests FROM m WHERE key IS NOT NULL GROUP BY key),
    d AS (SELECT lower(model_key) AS key, count(*) AS documents FROM documents WHERE model_key IS NOT NULL GROUP BY ALL) SELECT key, documents, coalesce(requests, 0) AS requests FROM d LEFT JOIN a USING (key)""",
    "ref_j7_mapping": "WITH r AS (SELECT * FROM request_props WHERE task_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY loaded_at DESC) = 1) SELECT regexp_replace(task_id, '-S[0-9]+(-[0-9]+)?$', '') = base_task_id AS agrees, count(*) AS n FROM r GROUP BY ALL",
    "ref_j11_contamination": f"""WITH {RECORDS}, e AS (SELECT {SPLIT} AS split, {BUILDING} AS building, unnest(target.guids) AS guid FROM t), b AS (SELECT building, guid FROM e WHERE building IS NOT NULL AND split IS NOT NULL GROUP BY ALL HAVING bool_or(split = 'train') AND bool_or(split <> 'train')) SELECT building, count(*) AS shared, list_sort(list(guid))[1:5] AS examples FROM b GROUP BY building""",
    "ref_m3_jaccard": f"""WITH {RECORDS}, w AS (SELECT list_distinct(regexp_extract_all(lower(prompt), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(instruction), '[a-z0-9]+')) AS b FROM t WHERE prompt IS NOT NULL AND instruction IS NOT NULL) SELECT floor(len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)) * 100)::BIGINT AS percent, count(*) AS n FROM w GROUP BY ALL""",
    "ref_m6_flatten": """WITH p AS (SELECT 'target.entity_type' AS name, target.entity_type AS value FROM task UNION ALL SELECT 'clarification.slot', clarification.slot FROM task UNION ALL SELECT 'clarification.question', clarification.question FROM task UNION ALL SELECT 'verification.gold_sha256', verification.gold_sha256 FROM task) SELECT name, count(value) AS filled, count(DISTINCT value) AS "values" FROM p GROUP BY name""",
    "ref_o1_mixed_order": "SELECT o_orderkey, floor(o_totalprice / 1000)::BIGINT AS k FROM orders ORDER BY k DESC, o_orderdate, o_orderkey LIMIT 100",
    "ref_o4_file_order": "WITH r AS (SELECT DISTINCT feed, file_seq, file_id, line_no FROM raw_record) SELECT *, row_number() OVER (PARTITION BY feed ORDER BY file_seq, file_id, line_no)::INT AS ordinal FROM r",
    "ref_o6_shuffle": f"WITH {POOL} SELECT rec_id FROM p ORDER BY md5(concat_ws('|', '7', rec_id::VARCHAR)), rec_id LIMIT 50",
    "ref_t2_numbers_observed": f"""WITH {RESULTS}, {REQUESTS}, s AS (SELECT adapter, task_id, {_N.format('reply')} AS said FROM r WHERE reply IS NOT NULL), g AS (SELECT task_id, list(DISTINCT x) AS given FROM (SELECT task_id, unnest({_N.format('text')}) AS x FROM q WHERE task_id IS NOT NULL) GROUP BY task_id)
    SELECT adapter, len(list_filter(said, lambda x: given IS NULL OR NOT list_contains(given, x)))::INT AS new_figures, count(*) AS n FROM s LEFT JOIN g USING (task_id) GROUP BY ALL""",
    "ref_t18_rebuild": "SELECT user_id, count(*) AS rounds, count(*) FILTER (event_type = 'error') AS errors, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS last_type FROM events GROUP BY user_id",
    "ref_u1_union_runs": "SELECT stage, stop_reason, count(*) AS n FROM (SELECT stage, NULL AS stop_reason FROM outcome UNION ALL SELECT NULL, stop_reason FROM task_result) GROUP BY ALL",
    "ref_u2_set_relations": f"""WITH {RESULTS}, s AS (SELECT adapter, list(task_id) AS l FROM r GROUP BY adapter) SELECT a.adapter AS a, b.adapter AS b, len(list_intersect(a.l, b.l))::BIGINT AS "both", len(a.l) - len(list_intersect(a.l, b.l)) AS only_a, len(b.l) - len(list_intersect(a.l, b.l)) AS only_b FROM s a JOIN s b ON a.adapter < b.adapter""",
    "ref_x4_wilson": f"""WITH {RESULTS}, {TASKS}, g AS (SELECT operation, count(*) AS n, count(*) FILTER ({DONE}) AS k FROM r JOIN k USING (task_id) GROUP BY operation), w AS (SELECT *, (k::DOUBLE / n + 1.96::DOUBLE * 1.96 / (2 * n)) / (1 + 1.96::DOUBLE * 1.96 / n) AS m, 1.96::DOUBLE * sqrt((k::DOUBLE / n) * (1 - k::DOUBLE / n) / n + 1.96::DOUBLE * 1.96 / (4 * n * n)) / (1 + 1.96::DOUBLE * 1.96 / n) AS h FROM g)
    SELECT operation, n, k, greatest(0.0, m - h) AS low, least(1.0, m + h) AS high FROM w""",
    "ref_x15_stability": f"WITH d AS (SELECT adapter, task_id, count(DISTINCT {DONE}) AS v FROM task_result WHERE adapter IS NOT NULL AND task_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1) SELECT adapter, count(*) AS repeated, count(*) FILTER (v > 1) AS flipped FROM d GROUP BY adapter",
    "ref_x21_errors": f"""WITH {RESULTS}, {TASKS}, e AS (SELECT {DONE} AS done, operation, floor((1 - score.final) * 1000)::BIGINT AS m FROM r JOIN k USING (task_id) WHERE score.final IS NOT NULL) SELECT done, operation, count(*) AS n, quantile_cont(m, 0.5) AS median, quantile_cont(m, 0.95) AS p95, max(m) AS most FROM e GROUP BY ALL""",
}
