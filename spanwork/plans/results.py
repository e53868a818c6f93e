"""Queries over runs of adapters: completion, classes, breakdowns, paired comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwork.functions import stats
from spanwork.plans.base import AXES, DONE, RESULTS, TASKS, completed, least_axis, results, tasks, verdicts
from spanwork.sources.tables import table

# How a run that did not complete ended, by stop reason.
STOPS = {"budget_exhausted": "round_limit", "context_overflow": "context_limit", "output_truncated": "context_limit", "completed": "reply_only"}
#: Families with fewer cases are not reported as worst.
FEWEST = 5


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with the labels of their task and the verdict."""
    return results(spark, sf_dir).join(tasks(spark, sf_dir), "task_id").withColumn("done", completed().cast("long"))


JOINED = f"WITH {RESULTS}, {TASKS}, v AS (SELECT *, {DONE}::BIGINT AS done FROM r JOIN k USING (task_id))"


def p1_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run completes when every axis reaches the threshold; two thresholds side by side."""
    return results(spark, sf_dir).select("adapter", "task_id", completed().alias("done"), completed(0.95).alias("done_strict"))


def p2_outcome_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rule that fits: completed, committed but rejected, or by stop reason."""
    stop = F.create_map(*[F.lit(x) for pair in STOPS.items() for x in pair])[F.col("stop_reason")]
    kind = F.when(completed(), "completed").when(F.col("committed"), "committed_rejected").otherwise(F.coalesce(stop, F.lit("other_stop")))
    return results(spark, sf_dir).groupBy("adapter", kind.alias("outcome")).agg(F.count("*").alias("n"))


def p2_end_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finer cascade that also looks at the last finish reason and at the error."""
    last = F.try_element_at("finish_reasons", F.lit(-1))
    rules = [
        (completed(), "completed"),
        (F.col("committed"), "wrong_commit"),
        (F.col("stop_reason") == "sandbox_crash", "sandbox_crash"),
        (F.col("stop_reason") == "tool_timeout", "tool_timeout"),
        ((F.col("stop_reason") == "output_truncated") | (last == "length"), "turn_truncated"),
        (F.col("stop_reason") == "context_overflow", "context_limit"),
        (F.col("stop_reason") == "budget_exhausted", "round_budget"),
        (F.length("error") > 0, "provider_error"),
        (F.col("stop_reason") == "completed", "reply_no_commit"),
    ]
    kind = F.coalesce(*[F.when(c, F.lit(name)) for c, name in rules], F.lit("other"))
    return results(spark, sf_dir).groupBy("adapter", kind.alias("ending")).agg(F.count("*").alias("n"))


def p9_well_formed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs all of whose calls are well formed and whose worst axis is above a floor; no calls are not well formed."""
    good = (F.col("tool_calls") > 0) & (F.col("well_formed_calls") == F.col("tool_calls")) & (least_axis() >= 0.5)
    return results(spark, sf_dir).where(good).select("adapter", "task_id")


def a1_result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = completed().cast("long")
    return (
        results(spark, sf_dir)
        .groupBy("adapter")
        .agg(F.count("*").alias("n"), F.sum(done).alias("n_done"), stats.ratio(F.sum(done), F.count("*")).alias("completion"), stats.ratio(F.sum("tool_rounds"), F.count("tool_rounds")).alias("mean_rounds"))
    )


def completion_by_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion with a Wilson interval by each dimension alone, by operation and category, and over all."""
    sets = [["operation"], ["category"], ["version"], ["origin"], ["tier"], ["operation", "category"], []]
    names = ["operation", "category", "version", "origin", "tier"]
    cells = joined(spark, sf_dir).groupingSets([["adapter", *s] for s in sets], "adapter", *names)
    rows = cells.agg(F.grouping_id().alias("cell"), F.count("*").alias("n"), F.sum("done").alias("n_done"))
    low, high = stats.wilson(F.col("n_done"), F.col("n"))
    return rows.select("adapter", "cell", *names, "n", "n_done", low.alias("low"), high.alias("high"))


def a3_tag_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run counts in every family of its task, and once in the family's layer (the part before the dot)."""
    tags = joined(spark, sf_dir).select("adapter", "task_id", "done", F.explode(F.array_distinct("families")).alias("family"))
    layers = tags.select("adapter", "task_id", "done", F.split_part("family", F.lit("."), F.lit(1)).alias("family")).distinct()
    kinds = tags.withColumn("kind", F.lit("family")).unionByName(layers.withColumn("kind", F.lit("layer")))
    return kinds.groupBy("adapter", "kind", "family").agg(F.count("*").alias("n"), F.sum("done").alias("n_done"))


def a4_clamped_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).groupBy("adapter", F.least("tool_calls", F.lit(10)).alias("calls")).agg(F.count("*").alias("n"))


def a5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three conventions: interpolated, nearest rank, and the element at the floor of 0.95 (n - 1)."""
    # one sorted array per adapter would gather a group: ranks come from a window over distinct values and their counts
    counts = results(spark, sf_dir).where("output_tokens is not null").groupBy("adapter", "output_tokens").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("adapter").orderBy("output_tokens"))
    ranked = counts.select("adapter", "output_tokens", upto.alias("upto"), F.sum("c").over(Window.partitionBy("adapter")).alias("n"))
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col("output_tokens")))
    n = F.col("n")
    exact = results(spark, sf_dir).groupBy("adapter").agg(F.percentile("output_tokens", F.lit(0.5)).alias("median"), F.percentile("output_tokens", F.lit(0.9)).alias("p90"), F.max("output_tokens").alias("most"))
    ranks = ranked.groupBy("adapter").agg(at(F.ceil(0.9 * n)).alias("p90_nearest"), at(F.floor(0.95 * (n - 1)) + 1).alias("p95_floor"))
    return exact.join(ranks, "adapter")


def a6_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion per building, then least, median and greatest over buildings."""
    per = joined(spark, sf_dir).where("building is not null").groupBy("adapter", "building").agg(stats.ratio(F.sum("done"), F.count("*")).alias("share"))
    return per.groupBy("adapter").agg(F.count("*").alias("n_buildings"), F.min("share").alias("least"), F.percentile("share", F.lit(0.5)).alias("median"), F.max("share").alias("most"))


def a7_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion without each building: total less group, no second pass over the rows."""
    per = joined(spark, sf_dir).where("building is not null").groupBy("adapter", "building").agg(F.count("*").alias("n"), F.sum("done").alias("d"))
    whole = Window.partitionBy("adapter")
    return per.select("adapter", "building", stats.ratio(F.sum("d").over(whole) - F.col("d"), F.sum("n").over(whole) - F.col("n")).alias("without"))


def a8_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion at each threshold in one pass: conditional sums, then turned into rows."""
    cuts = {85: 0.85, 90: 0.9, 95: 0.95, 98: 0.98}
    sums = [F.sum(completed(t).cast("long")).alias(f"t{k}") for k, t in cuts.items()]
    rows = results(spark, sf_dir).groupBy("adapter").agg(F.count("*").alias("n"), *sums)
    return rows.select("adapter", "n", F.expr("stack(4, " + ", ".join(f"{k}, t{k}" for k in cuts) + ") as (percent, n_done)"))


def a15_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of every two adapters on the tasks both ran: counts, exact test, interval, tests adjusted over the family."""
    v = verdicts(spark, sf_dir).select("task_id", "adapter", "done")
    a, b = v.toDF("task_id", "a", "x"), v.toDF("task_id", "b", "y")
    cells = a.join(b, "task_id").where("a < b").groupBy("a", "b").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("x") & F.col("y")).alias("n11"),
        F.count_if(F.col("x") & ~F.col("y")).alias("n12"),
        F.count_if(~F.col("x") & F.col("y")).alias("n21"),
        F.count_if(~F.col("x") & ~F.col("y")).alias("n22"),
    )
    return cells


def x9_paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cells with difference, exact test and Newcombe interval."""
    cells = a15_contingency(spark, sf_dir)
    n11, n12, n21, n22 = (F.col(c) for c in ("n11", "n12", "n21", "n22"))
    low, high = stats.newcombe_paired(n11, n12, n21, n22)
    return cells.select("a", "b", "n", stats.ratio(n12 - n21, F.col("n")).alias("difference"), stats.mcnemar_exact(n12, n21).alias("p"), low.alias("low"), high.alias("high"))


def x8_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact tests of all pairs of adapters, adjusted as one family."""
    p = x9_paired_difference(spark, sf_dir).select("a", "b", "p")
    step = p.withColumn("step", stats.holm(F.col("p"), "a", "b"))
    return step.select("a", "b", "p", stats.running_max(F.col("step"), "p", "a", "b").alias("p_adjusted"))


def x5_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion of native less that of migrated models, per adapter, with a hybrid interval."""
    side = lambda o: [F.count_if(F.col("origin") == o).alias(f"n_{o}"), F.sum(F.when(F.col("origin") == o, F.col("done")).otherwise(0)).alias(f"k_{o}")]
    rows = joined(spark, sf_dir).groupBy("adapter").agg(*side("native"), *side("migrated"))
    low, high = stats.newcombe_independent(F.col("k_native"), F.col("n_native"), F.col("k_migrated"), F.col("n_migrated"))
    return rows.select("adapter", low.alias("low"), high.alias("high"))


def x12_fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact test of origin against completion, per adapter, on the runs of one operation."""
    cell = lambda o, d: F.count_if((F.col("origin") == o) & (F.col("done") == d))
    rows = joined(spark, sf_dir).where("operation = 'delete'").groupBy("adapter").agg(*[cell(o, d).alias(f"{o}_{d}") for o in ("native", "migrated") for d in (1, 0)])
    p = stats.fisher_exact(F.col("native_1"), F.col("native_0"), F.col("migrated_1"), F.col("migrated_0"))
    return rows.select("adapter", "native_1", "native_0", "migrated_1", "migrated_0", p.alias("p"))


def x10_difference_in_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more one adapter gains over another on one category than on the other, over tasks all four runs exist for."""
    rows = joined(spark, sf_dir).groupBy("adapter", "category").agg(F.count("*").alias("n"), F.sum("done").alias("d"))
    side = lambda c: rows.where(F.col("category") == c).select("adapter", stats.ratio(F.col("d"), F.col("n")).alias(c))
    both = side("direct").join(side("spatial"), "adapter")
    other = both.toDF("other", "direct_o", "spatial_o")
    gain = (F.col("direct") - F.col("direct_o")) - (F.col("spatial") - F.col("spatial_o"))
    return both.join(other, F.col("adapter") < F.col("other")).select("adapter", "other", gain.alias("gain"))


def a16_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks on which adapters do not agree."""
    return results(spark, sf_dir).groupBy("task_id").agg(F.count("*").alias("n"), F.count_distinct(completed()).alias("verdicts")).where("verdicts > 1")


def a18_pooled_and_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of running calls: pooled over all calls, and as the mean over runs with calls (in millionths)."""
    part = F.floor(1_000_000 * F.col("running_calls") / F.nullif(F.col("tool_calls"), F.lit(0)))
    return results(spark, sf_dir).groupBy("adapter").agg(stats.ratio(F.sum("running_calls"), F.sum("tool_calls")).alias("pooled"), stats.ratio(F.sum(part), F.count(part)).alias("mean_millionths"))


def a19_rank_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of adapters whose order by completion differs between two versions."""
    rows = joined(spark, sf_dir).where("version is not null").groupBy("version", "adapter").agg(F.sum("done").alias("d"), F.count("*").alias("n"))
    a, b = rows.toDF("version", "a", "da", "na"), rows.toDF("version", "b", "db", "nb")
    sign = a.join(b, "version").where("a < b").select("version", "a", "b", F.signum(F.col("da") * F.col("nb") - F.col("db") * F.col("na")).alias("s"))
    return sign.groupBy("a", "b").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo < 0 and hi > 0").select("a", "b")


def a25_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of one adapter that another repeats: same task, same final score, same reply."""
    r = results(spark, sf_dir).select("task_id", "adapter", F.col("score.final").alias("final"), "reply").where("final is not null and reply is not null")
    return r.toDF("task_id", "a", "final", "reply").join(r.toDF("task_id", "b", "final", "reply"), ["task_id", "final", "reply"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def o2_failing_then_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per adapter the hardest 20 runs: all failing ones if they are more, else filled up with the lowest scores."""
    rows = results(spark, sf_dir).where("score.final is not null").withColumn("done", completed())
    by = Window.partitionBy("adapter").orderBy("done", F.col("score.final"), "task_id")
    failing = F.count_if(~F.col("done")).over(Window.partitionBy("adapter"))
    return rows.withColumn("rn", F.row_number().over(by)).withColumn("take", F.greatest(F.lit(20), failing)).where("rn <= take").select("adapter", "task_id", "rn")


def o3_best_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reported adapter: most completed, then fewest rounds, then name."""
    rows = results(spark, sf_dir).groupBy("adapter").agg(F.sum(completed().cast("long")).alias("d"), F.sum("tool_rounds").alias("rounds"))
    return rows.orderBy(F.desc("d"), "rounds", "adapter").limit(1)


def x16_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and milliseconds per completed edit; null where nothing completed."""
    done = F.sum(completed().cast("long"))
    ms = F.sum(F.floor(F.col("duration_seconds") * 1000))
    tokens = F.sum("input_tokens") + F.sum("output_tokens")
    return results(spark, sf_dir).groupBy("adapter").agg(stats.ratio(tokens, done).alias("tokens_per_done"), stats.ratio(ms, done).alias("ms_per_done"))


def x18_group_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pair of adapters, the buildings on which the first completes more, as many, fewer."""
    rows = joined(spark, sf_dir).where("building is not null").groupBy("building", "adapter").agg(F.sum("done").alias("d"), F.count("*").alias("n"))
    a, b = rows.toDF("building", "a", "da", "na"), rows.toDF("building", "b", "db", "nb")
    sign = F.signum(F.col("da") * F.col("nb") - F.col("db") * F.col("na"))
    return a.join(b, "building").where("a < b").groupBy("a", "b").agg(F.count_if(sign > 0).alias("more"), F.count_if(sign == 0).alias("same"), F.count_if(sign < 0).alias("fewer"))


def x20_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts that a relaxed reading (two axes of three) changes."""
    good = reduce(lambda x, y: x + y, [(F.coalesce(F.col(f"score.{a}"), F.lit(0.0)) >= 0.9).cast("int") for a in AXES])
    return results(spark, sf_dir).groupBy("adapter").agg(F.count_if(completed()).alias("strict"), F.count_if(good >= 2).alias("relaxed"))


def a17_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapters ranked by score per task: is the best adapter overall among the first k, and its mean rank."""
    by = Window.partitionBy("task_id").orderBy(F.desc_nulls_last("score.final"), "adapter")
    ranked = results(spark, sf_dir).select("task_id", "adapter", F.row_number().over(by).alias("rank"))
    return ranked.groupBy("adapter").agg(F.count("*").alias("n"), *[F.count_if(F.col("rank") <= k).alias(f"at_{k}") for k in (1, 2, 3)], F.sum("rank").alias("rank_sum"))


def r13_worst_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five families with the lowest completion among those with enough runs."""
    rows = a3_tag_count(spark, sf_dir).where("kind = 'family'").groupBy("family").agg(F.sum("n").alias("n"), F.sum("n_done").alias("n_done")).where(F.col("n") >= FEWEST)
    return rows.orderBy(F.col("n_done") / F.col("n"), "family").limit(5)


def s2_unscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of a strict scan as counts that should be 0: repeated keys, missing scores, tasks nobody knows."""
    raw = table(spark, sf_dir, "task_result")
    known = table(spark, sf_dir, "task").select("task_id").where("task_id is not null").distinct()
    repeated = raw.groupBy("adapter", "task_id").count().where("count > 1").agg(F.count("*").alias("repeated"))
    missing = raw.agg(F.count_if(F.col("score.final").isNull()).alias("unscored"))
    strangers = raw.select("task_id").distinct().join(known, "task_id", "left_anti").agg(F.count("*").alias("unknown"))
    return repeated.crossJoin(missing).crossJoin(strangers)  # three single rows


def j2_paired_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before pairing two runs: ids only one of them has."""
    ids = results(spark, sf_dir).select("adapter", "task_id")
    every = ids.groupBy("task_id").agg(F.count("*").alias("c"), F.min("adapter").alias("one"))
    width = ids.agg(F.count_distinct("adapter").alias("w"))
    return every.crossJoin(width).groupBy((F.col("c") == F.col("w")).alias("complete")).agg(F.count("*").alias("n"))


_LOG_CHOOSE = "(lgamma({0} + 1.0) - lgamma({1} + 1.0) - lgamma({0} - ({1}) + 1.0))"
_Z = 1.959963984540054
_LOW, _HIGH = (f"(({{0}} + {_Z * _Z / 2}) / (n + {_Z * _Z}) {sign} {_Z} * sqrt({{0}} * (n - {{0}}) / n::DOUBLE + {_Z * _Z / 4}) / (n + {_Z * _Z}))" for sign in "-+")
_TESTS = f"""t AS (SELECT *, n11 + n12 AS k, n11 + n21 AS l FROM c),
w AS (SELECT *, k / n::DOUBLE AS p1, l / n::DOUBLE AS p2, greatest(0.0, {_LOW.format("k")}) AS l1, least(1.0, {_HIGH.format("k")}) AS u1, greatest(0.0, {_LOW.format("l")}) AS l2, least(1.0, {_HIGH.format("l")}) AS u2,
  CASE WHEN k * (n - k) * l * (n - l) > 0 THEN (n11 * n22 - n12 * n21) / sqrt(k::DOUBLE * (n - k) * l * (n - l)) ELSE 0 END AS phi FROM t),
x AS (SELECT a, b, n, (n12 - n21) / n::DOUBLE AS difference,
  CASE WHEN n12 + n21 = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(n12, n21) + 1), lambda i: exp({_LOG_CHOOSE.format("(n12 + n21)", "i")} - (n12 + n21) * ln(2.0))))) END AS p,
  greatest(-1.0, p1 - p2 - sqrt(greatest(0.0, (p1 - l1) ^ 2 - 2 * phi * (p1 - l1) * (u2 - p2) + (u2 - p2) ^ 2))) AS low,
  least(1.0, p1 - p2 + sqrt(greatest(0.0, (u1 - p1) ^ 2 - 2 * phi * (u1 - p1) * (p2 - l2) + (p2 - l2) ^ 2))) AS high FROM w)"""
_PAIRS = f"""WITH {RESULTS}, v AS (SELECT task_id, adapter, {DONE} AS done FROM r),
c AS (SELECT x.adapter AS a, y.adapter AS b, count(*) AS n, count(*) FILTER (x.done AND y.done) AS n11, count(*) FILTER (x.done AND NOT y.done) AS n12,
  count(*) FILTER (NOT x.done AND y.done) AS n21, count(*) FILTER (NOT x.done AND NOT y.done) AS n22 FROM v x JOIN v y USING (task_id) WHERE x.adapter < y.adapter GROUP BY ALL)"""
_Z = "1.959963984540054"


def _wilson_sql(k: str, n: str) -> tuple[str, str]:
    k, n = f"({k})::DOUBLE", f"({n})::DOUBLE"
    middle = f"(({k} / {n} + {_Z} * {_Z} / (2 * {n})) / (1 + {_Z} * {_Z} / {n}))"
    half = f"({_Z} * sqrt(({k} / {n}) * (1 - {k} / {n}) / {n} + {_Z} * {_Z} / (4 * {n} * {n})) / (1 + {_Z} * {_Z} / {n}))"
    return f"greatest(0.0, {middle} - {half})", f"least(1.0, {middle} + {half})"


_W = _wilson_sql("n_done", "n")
_WA, _WB = _wilson_sql("n11 + n12", "n"), _wilson_sql("n11 + n21", "n")
_CHOOSE = "coalesce((SELECT sum(ln(({n} - {k} + i)::DOUBLE / i)) FROM range(1, ({k})::BIGINT + 1) t(i)), 0)"
_P = f"CASE WHEN n12 + n21 = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(n12 + n21 + 1.0) - lgamma(j + 1.0) - lgamma(n12 + n21 - j + 1.0) - (n12 + n21) * ln(2.0))) FROM range(0, least(n12, n21) + 1) u(j))) END"

QUERIES = {
    "completion_by_dim": completion_by_dim,
    "ref_p1_thresholds": p1_thresholds,
    "ref_p2_outcome_class": p2_outcome_class,
    "ref_p2_end_class": p2_end_class,
    "ref_p9_well_formed": p9_well_formed,
    "ref_a1_result_summary": a1_result_summary,
    "ref_a3_tag_count": a3_tag_count,
    "ref_a4_clamped_histogram": a4_clamped_histogram,
    "ref_a5_percentiles": a5_percentiles,
    "ref_a6_two_levels": a6_two_levels,
    "ref_a7_leave_one_out": a7_leave_one_out,
    "ref_a8_threshold_sweep": a8_threshold_sweep,
    "ref_a15_contingency": a15_contingency,
    "ref_a16_disagreement": a16_disagreement,
    "ref_a17_recall_at_k": a17_recall_at_k,
    "ref_a18_pooled_and_mean": a18_pooled_and_mean,
    "ref_a19_rank_reversals": a19_rank_reversals,
    "ref_a25_reuse": a25_reuse,
    "ref_j2_paired_ids": j2_paired_ids,
    "ref_o2_failing_then_fill": o2_failing_then_fill,
    "ref_o3_best_adapter": o3_best_adapter,
    "ref_r13_worst_families": r13_worst_families,
    "ref_s2_unscored": s2_unscored,
    "ref_x5_independent": x5_independent,
    "ref_x8_holm": x8_holm,
    "ref_x9_paired_difference": x9_paired_difference,
    "ref_x10_difference_in_differences": x10_difference_in_differences,
    "ref_x12_fisher": x12_fisher,
    "ref_x16_cost": x16_cost,
    "ref_x18_group_gains": x18_group_gains,
    "ref_x20_relaxed": x20_relaxed,
}
SQL = {
    "completion_by_dim": f"""{JOINED}, g AS (SELECT adapter, grouping(adapter, operation, category, version, origin, tier)::BIGINT AS cell, operation, category, version, origin, tier,
    count(*) AS n, sum(done)::BIGINT AS n_done FROM v GROUP BY GROUPING SETS ((adapter, operation), (adapter, category), (adapter, version), (adapter, origin), (adapter, tier), (adapter, operation, category), (adapter)))
    SELECT *, {_W[0]} AS low, {_W[1]} AS high FROM g""",
    "ref_p1_thresholds": f"WITH {RESULTS} SELECT adapter, task_id, {DONE} AS done, {DONE.replace('0.9)', '0.95)')} AS done_strict FROM r",
    "ref_p2_outcome_class": f"""WITH {RESULTS} SELECT adapter, CASE WHEN {DONE} THEN 'completed' WHEN committed THEN 'committed_rejected' WHEN stop_reason = 'budget_exhausted' THEN 'round_limit'
    WHEN stop_reason IN ('context_overflow', 'output_truncated') THEN 'context_limit' WHEN stop_reason = 'completed' THEN 'reply_only' ELSE 'other_stop' END AS outcome, count(*) AS n FROM r GROUP BY ALL""",
    "ref_p2_end_class": f"""WITH {RESULTS} SELECT adapter, CASE WHEN {DONE} THEN 'completed' WHEN committed THEN 'wrong_commit' WHEN stop_reason = 'sandbox_crash' THEN 'sandbox_crash'
    WHEN stop_reason = 'tool_timeout' THEN 'tool_timeout' WHEN stop_reason = 'output_truncated' OR finish_reasons[-1] = 'length' THEN 'turn_truncated' WHEN stop_reason = 'context_overflow' THEN 'context_limit'
    WHEN stop_reason = 'budget_exhausted' THEN 'round_budget' WHEN length(error) > 0 THEN 'provider_error' WHEN stop_reason = 'completed' THEN 'reply_no_commit' ELSE 'other' END AS ending, count(*) AS n FROM r GROUP BY ALL""",
    "ref_p9_well_formed": f"WITH {RESULTS} SELECT adapter, task_id FROM r WHERE tool_calls > 0 AND well_formed_calls = tool_calls AND {DONE.replace('0.9)', '0.5)')}",
    "ref_a1_result_summary": f"""WITH {RESULTS} SELECT adapter, count(*) AS n, sum({DONE}::BIGINT)::BIGINT AS n_done, sum({DONE}::BIGINT)::DOUBLE / count(*) AS completion,
    sum(tool_rounds)::DOUBLE / count(tool_rounds) AS mean_rounds FROM r GROUP BY adapter""",
    "ref_a3_tag_count": f"""{JOINED}, f AS (SELECT DISTINCT adapter, task_id, done, unnest(families) AS family FROM v), l AS (SELECT DISTINCT adapter, task_id, done, split_part(family, '.', 1) AS family FROM f)
    SELECT adapter, kind, family, count(*) AS n, sum(done)::BIGINT AS n_done FROM (SELECT *, 'family' AS kind FROM f UNION ALL SELECT *, 'layer' FROM l) GROUP BY ALL""",
    "ref_a4_clamped_histogram": f"WITH {RESULTS} SELECT adapter, least(tool_calls, 10)::INT AS calls, count(*) AS n FROM r GROUP BY ALL",
    "ref_a5_percentiles": f"""WITH {RESULTS}, o AS (SELECT adapter, list_sort(list(output_tokens)) AS s FROM r WHERE output_tokens IS NOT NULL GROUP BY adapter)
    SELECT adapter, quantile_cont(output_tokens, 0.5) AS median, quantile_cont(output_tokens, 0.9) AS p90, max(output_tokens) AS most, any_value(s[ceil(0.9 * len(s))::INT]) AS p90_nearest, any_value(s[floor(0.95 * (len(s) - 1))::INT + 1]) AS p95_floor
    FROM r JOIN o USING (adapter) GROUP BY adapter""",
    "ref_a6_two_levels": f"""{JOINED}, b AS (SELECT adapter, building, sum(done)::DOUBLE / count(*) AS share FROM v WHERE building IS NOT NULL GROUP BY ALL)
    SELECT adapter, count(*) AS n_buildings, min(share) AS least, quantile_cont(share, 0.5) AS median, max(share) AS most FROM b GROUP BY adapter""",
    "ref_a7_leave_one_out": f"""{JOINED}, b AS (SELECT adapter, building, count(*) AS n, sum(done) AS d FROM v WHERE building IS NOT NULL GROUP BY ALL)
    SELECT adapter, building, (sum(d) OVER w - d)::DOUBLE / nullif(sum(n) OVER w - n, 0) AS without FROM b WINDOW w AS (PARTITION BY adapter)""",
    "ref_a8_threshold_sweep": f"""WITH {RESULTS} SELECT adapter, count(*) AS n, p AS percent, sum((least(coalesce(score.geometry, 0), coalesce(score.semantics, 0), coalesce(score.topology, 0)) >= t)::BIGINT)::BIGINT AS n_done
    FROM r, (VALUES (85, 0.85::DOUBLE), (90, 0.9::DOUBLE), (95, 0.95::DOUBLE), (98, 0.98::DOUBLE)) x(p, t) GROUP BY adapter, p""",
    "ref_a15_contingency": f"{_PAIRS} SELECT * FROM c",
    "ref_x9_paired_difference": f"{_PAIRS}, {_TESTS} SELECT a, b, n, difference, p, low, high FROM x",
    "ref_x8_holm": f"""{_PAIRS}, {_TESTS}, s AS (SELECT a, b, p, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, a, b) + 1) * p) AS step FROM x)
    SELECT a, b, p, max(step) OVER (ORDER BY p, a, b ROWS UNBOUNDED PRECEDING) AS p_adjusted FROM s""",
    "ref_x12_fisher": f"""{JOINED}, t AS (SELECT adapter, count(*) FILTER (origin = 'native' AND done = 1) AS native_1, count(*) FILTER (origin = 'native' AND done = 0) AS native_0,
      count(*) FILTER (origin = 'migrated' AND done = 1) AS migrated_1, count(*) FILTER (origin = 'migrated' AND done = 0) AS migrated_0 FROM v WHERE operation = 'delete' GROUP BY adapter),
    e AS (SELECT *, native_1 + native_0 AS r, native_1 + migrated_1 AS k, native_1 + native_0 + migrated_1 + migrated_0 AS n FROM t),
    f AS (SELECT *, unnest(range(greatest(0, k - (n - r)), least(r, k) + 1)) AS i FROM e),
    g AS (SELECT *, {_LOG_CHOOSE.format("r", "i")} + {_LOG_CHOOSE.format("n - r", "k - i")} - {_LOG_CHOOSE.format("n", "k")} AS lp FROM f),
    h AS (SELECT *, max(CASE WHEN i = native_1 THEN lp END) OVER (PARTITION BY adapter) AS own FROM g)
    SELECT adapter, native_1, native_0, migrated_1, migrated_0, least(1.0, sum(exp(lp)) FILTER (lp <= own + 1e-7)) AS p FROM h GROUP BY ALL""",
    "ref_a16_disagreement": f"WITH {RESULTS} SELECT task_id, count(*) AS n, count(DISTINCT {DONE}) AS verdicts FROM r GROUP BY task_id HAVING count(DISTINCT {DONE}) > 1",
    "ref_a17_recall_at_k": f"""WITH {RESULTS}, k AS (SELECT adapter, row_number() OVER (PARTITION BY task_id ORDER BY score.final DESC NULLS LAST, adapter) AS rank FROM r)
    SELECT adapter, count(*) AS n, count(*) FILTER (rank <= 1) AS at_1, count(*) FILTER (rank <= 2) AS at_2, count(*) FILTER (rank <= 3) AS at_3, sum(rank)::BIGINT AS rank_sum FROM k GROUP BY adapter""",
    "ref_a18_pooled_and_mean": f"""WITH {RESULTS} SELECT adapter, sum(running_calls)::DOUBLE / sum(tool_calls) AS pooled, sum(floor(1000000 * running_calls / nullif(tool_calls, 0)))::DOUBLE / count(nullif(tool_calls, 0)) AS mean_millionths FROM r GROUP BY adapter""",
    "ref_a19_rank_reversals": f"""{JOINED}, g AS (SELECT version, adapter, sum(done)::BIGINT AS d, count(*) AS n FROM v WHERE version IS NOT NULL GROUP BY ALL),
    s AS (SELECT x.adapter AS a, y.adapter AS b, sign(x.d * y.n - y.d * x.n) AS s FROM g x JOIN g y USING (version) WHERE x.adapter < y.adapter) SELECT a, b FROM s GROUP BY a, b HAVING min(s) < 0 AND max(s) > 0""",
    "ref_a25_reuse": f"""WITH {RESULTS} SELECT x.adapter AS a, y.adapter AS b, count(*) AS n FROM r x JOIN r y ON x.task_id = y.task_id AND x.score.final = y.score.final AND x.reply = y.reply AND x.adapter < y.adapter GROUP BY ALL""",
    "ref_j2_paired_ids": f"""WITH {RESULTS}, c AS (SELECT task_id, count(*) AS c FROM r GROUP BY task_id) SELECT c = (SELECT count(DISTINCT adapter) FROM r) AS complete, count(*) AS n FROM c GROUP BY ALL""",
    "ref_o2_failing_then_fill": f"""WITH {RESULTS}, o AS (SELECT adapter, task_id, row_number() OVER (PARTITION BY adapter ORDER BY {DONE}, score.final, task_id)::INT AS rn, count(*) FILTER (NOT {DONE}) OVER (PARTITION BY adapter) AS f
    FROM r WHERE score.final IS NOT NULL) SELECT adapter, task_id, rn FROM o WHERE rn <= greatest(20, f)""",
    "ref_o3_best_adapter": f"WITH {RESULTS} SELECT adapter, sum({DONE}::BIGINT)::BIGINT AS d, sum(tool_rounds)::BIGINT AS rounds FROM r GROUP BY adapter ORDER BY d DESC, rounds, adapter LIMIT 1",
    "ref_r13_worst_families": f"""{JOINED}, f AS (SELECT DISTINCT adapter, task_id, done, unnest(families) AS family FROM v) SELECT family, count(*) AS n, sum(done)::BIGINT AS n_done FROM f GROUP BY family HAVING count(*) >= 5
    ORDER BY sum(done)::DOUBLE / count(*), family LIMIT 5""",
    "ref_s2_unscored": """SELECT (SELECT count(*) FROM (SELECT 1 FROM task_result GROUP BY adapter, task_id HAVING count(*) > 1)) AS repeated, (SELECT count(*) FROM task_result WHERE score.final IS NULL) AS unscored,
    (SELECT count(DISTINCT task_id) FROM task_result WHERE task_id NOT IN (SELECT task_id FROM task WHERE task_id IS NOT NULL)) AS "unknown" """,
    "ref_x5_independent": f"""{JOINED}, s AS (SELECT adapter, count(*) FILTER (origin = 'native') AS n1, sum(CASE WHEN origin = 'native' THEN done ELSE 0 END) AS k1, count(*) FILTER (origin = 'migrated') AS n2, sum(CASE WHEN origin = 'migrated' THEN done ELSE 0 END) AS k2 FROM v GROUP BY adapter),
    w AS (SELECT *, k1::DOUBLE / n1 AS p, k2::DOUBLE / n2 AS q, {_wilson_sql('k1', 'n1')[0]} AS lp, {_wilson_sql('k1', 'n1')[1]} AS up, {_wilson_sql('k2', 'n2')[0]} AS lq, {_wilson_sql('k2', 'n2')[1]} AS uq FROM s)
    SELECT adapter, (p - q) - sqrt((p - lp) * (p - lp) + (uq - q) * (uq - q)) AS low, (p - q) + sqrt((up - p) * (up - p) + (q - lq) * (q - lq)) AS high FROM w""",
    "ref_x10_difference_in_differences": f"""{JOINED}, s AS (SELECT adapter, sum(CASE WHEN category = 'direct' THEN done END)::DOUBLE / count(*) FILTER (category = 'direct') AS direct, sum(CASE WHEN category = 'spatial' THEN done END)::DOUBLE / count(*) FILTER (category = 'spatial') AS spatial FROM v GROUP BY adapter)
    SELECT x.adapter, y.adapter AS other, (x.direct - y.direct) - (x.spatial - y.spatial) AS gain FROM s x JOIN s y ON x.adapter < y.adapter""",
    "ref_x16_cost": f"""WITH {RESULTS} SELECT adapter, (sum(input_tokens) + sum(output_tokens))::DOUBLE / nullif(sum({DONE}::BIGINT), 0)::DOUBLE AS tokens_per_done, sum(floor(duration_seconds * 1000))::DOUBLE / nullif(sum({DONE}::BIGINT), 0)::DOUBLE AS ms_per_done FROM r GROUP BY adapter""",
    "ref_x18_group_gains": f"""{JOINED}, g AS (SELECT building, adapter, sum(done)::BIGINT AS d, count(*) AS n FROM v WHERE building IS NOT NULL GROUP BY ALL) SELECT x.adapter AS a, y.adapter AS b, count(*) FILTER (x.d * y.n > y.d * x.n) AS more,
    count(*) FILTER (x.d * y.n = y.d * x.n) AS same, count(*) FILTER (x.d * y.n < y.d * x.n) AS fewer FROM g x JOIN g y USING (building) WHERE x.adapter < y.adapter GROUP BY ALL""",
    "ref_x20_relaxed": f"""WITH {RESULTS} SELECT adapter, count(*) FILTER ({DONE}) AS strict, count(*) FILTER ((coalesce(score.geometry, 0) >= 0.9)::INT + (coalesce(score.semantics, 0) >= 0.9)::INT + (coalesce(score.topology, 0) >= 0.9)::INT >= 2) AS relaxed FROM r GROUP BY adapter""",
}
