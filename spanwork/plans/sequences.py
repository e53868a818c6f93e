"""Queries over sequences of calls, rewards, preference pairs, resampling."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from spanwork.functions import kernels, rewards, text
from spanwork.operators.selection import depth
from spanwork.plans.base import DONE, RECORDS, RESULTS, completed, records, results
from spanwork.plans.results import a15_contingency, joined
from spanwork.plans.selecting import POOL, pool
from spanwork.sources.tables import table


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls of a session: the key is what they name."""
    return table(spark, sf_dir, "events").withColumn("key", F.get_json_object("props", "$.k").cast("int"))


CALLS = "e AS (SELECT *, json_extract_string(props, '$.k')::INT AS key FROM events)"


def t1_observed_before_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors that name a key that no earlier event of the user had shown."""
    e = _calls(spark, sf_dir)
    seen = e.where("event_type <> 'error'").groupBy("user_id", "key").agg(F.min(F.struct("ts", "event_id")).alias("seen"))
    used = e.where("event_type = 'error'").join(seen, ["user_id", "key"], "left")
    fresh = F.col("seen").isNull() | (F.col("seen") > F.struct("ts", "event_id"))
    return used.where(fresh).groupBy("user_id").agg(F.count("*").alias("unobserved"))


def t7_call_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir)
    return r.groupBy("adapter").agg(F.sum("tool_calls").alias("calls"), F.sum(F.col("tool_calls") - F.col("well_formed_calls")).alias("malformed"), F.sum(F.col("well_formed_calls") - F.col("running_calls")).alias("raised"), F.sum("commits").alias("commits"))


def t9_kind_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users all, some or none of whose last ten events are errors."""
    by = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(by)).where("rn <= 10").groupBy("user_id").agg(F.every(F.col("event_type") == "error").alias("a"), F.some(F.col("event_type") == "error").alias("s"))
    return last.groupBy(F.when(F.col("a"), "all").when(F.col("s"), "some").otherwise("none").alias("errors")).agg(F.count("*").alias("n"))


def t10_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit kinds that train records use, with the share of evaluation records of that kind."""
    kinds = table(spark, sf_dir, "task").select("rec_id", "edit_kind").distinct()
    train = pool(spark, sf_dir).select("rec_id").withColumn("train", F.lit(1))
    rows = kinds.join(train, "rec_id", "left").groupBy("edit_kind").agg(F.count("train").alias("n_train"), F.count("*").alias("n"))
    return rows.where("edit_kind is not null")


def t11_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reward of each run in millionths: normalised by the untouched model's score, less failed calls, nothing to gain without commit."""
    null = table(spark, sf_dir, "task").where("task_id is not null").groupBy("task_id").agg(F.max("verification.null_edit_score").alias("untouched"))
    raw = rewards.normalised(F.col("score.final"), F.col("untouched"))
    shaped = rewards.commit_gate(rewards.less_errors(raw, F.coalesce(F.col("tool_calls") - F.col("running_calls"), F.lit(0))), F.col("committed"))
    return results(spark, sf_dir).join(null, "task_id").select("adapter", "task_id", F.floor(raw * 1_000_000 + 0.5).alias("raw"), F.floor(shaped * 1_000_000 + 0.5).alias("shaped"))


def t12_key_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the required identifiers of a record its request names."""
    r = records(spark, sf_dir, "prompt", "instruction", "target").withColumn("text", F.coalesce("prompt", "instruction")).where("text is not null and target.guids is not null")
    named = F.size(F.array_intersect(F.array_distinct("target.guids"), text.guids(F.col("text"))))
    return r.groupBy(F.size(F.array_distinct("target.guids")).alias("required"), named.alias("named")).agg(F.count("*").alias("n"))


def t13_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per task the best run against runs that are worse by at least 0.3 or never ran: those that failed first, then the lowest, at
    most two."""
    r = results(spark, sf_dir).where("score.final is not null").select("task_id", "adapter", F.col("score.final").alias("final"), (F.col("running_calls") < F.col("tool_calls")).alias("raised"))
    best = r.withColumn("rn", F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("final"), "adapter"))).where("rn = 1 and final >= 0.5").select("task_id", F.col("adapter").alias("chosen"), F.col("final").alias("top"))
    pairs = r.join(best, "task_id").where("adapter <> chosen and (top - final >= 0.3 or (raised and final < top))")
    return pairs.withColumn("rank", depth(["task_id"], F.desc_nulls_last("raised"), "final", "adapter")).where("rank <= 2").select("task_id", "chosen", F.col("adapter").alias("rejected"), "rank")


def t14_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First error of each user and key, with the number of errors that follow."""
    e = _calls(spark, sf_dir).where("event_type = 'error'")
    return e.groupBy("user_id", "key").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"), (F.count("*") - 1).alias("later"))


def t15_class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "outcome").groupBy("stage", "reason").agg(F.count("*").alias("n"))
    return o.select("stage", "reason", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("stage"))).alias("share"))


def t16_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train rows that are kept, by the first reason to drop one: repeated request, test building, too long."""
    rows = records(spark, sf_dir, "prompt", "instruction", "created_at").select("rec_id", F.coalesce("prompt", "instruction").alias("text"), "created_at").join(pool(spark, sf_dir).select("rec_id", "model", "building"), "rec_id")
    rows = rows.withColumn("copy", depth(["model", "text"], "created_at", "rec_id"))
    why = F.when(F.col("text").isNull(), "no text").when(F.col("copy") > 1, "repeated").when(F.col("building").isNull(), "no building").when(F.length("text") > 300, "too long").otherwise("kept")
    return rows.groupBy(why.alias("why")).agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"))


def t17_harvest(spark: SparkSession, sf_dir: str, most: int = 2, percent: int = 30) -> DataFrame:
    """Per building the first requests that differ by words from those kept before, at most two.

    The result depends on the order, so a building's rows stream through one task in order; it holds the kept ones alone.
    """
    rows = records(spark, sf_dir, "prompt").where("prompt is not null").join(pool(spark, sf_dir).select("rec_id", "building"), "rec_id").where("building is not null")
    rows = rows.select("building", "rec_id", F.array_distinct(text.words(F.col("prompt"))).alias("words")).repartition("building").sortWithinPartitions("building", "rec_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept = None, []
        for batch in batches:
            out = []
            for building, rec_id, words in zip(*(c.to_pylist() for c in batch.columns)):
                if building != at:
                    at, kept = building, []
                mine = set(words)
                if len(kept) < most and not any(100 * len(k & mine) >= percent * len(k | mine) for k in kept):
                    kept.append(mine)
                    out.append((building, rec_id))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], names=["building", "rec_id"])

    return rows.mapInArrow(run, "building string, rec_id long")


def t19_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that mention paths, and among them those that leave the project's folder."""
    path = F.col("reply").rlike(r"(?i)[a-z0-9_]+/[a-z0-9_]+\.[a-z0-9]+")
    out = F.col("reply").rlike(r"(\.\./|/etc/|/root/)")
    return results(spark, sf_dir).groupBy("adapter").agg(F.count_if(path).alias("paths"), F.count_if(out).alias("outside"), F.count_if(F.col("reply").isNull()).alias("silent"))


def x1_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile intervals of the mean final score, from its histogram in thousandths: drawing n scores with replacement is one
    multinomial draw over at most 1001 values, so the group a task sees is bounded."""
    h = results(spark, sf_dir).where("score.final is not null").groupBy("adapter", F.floor(F.col("score.final") * 1000).alias("v")).agg(F.count("*").alias("c"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        mean, low, high = kernels.histogram_bootstrap(pdf["v"], pdf["c"])
        return pd.DataFrame({"adapter": [key[0]], "n": [int(pdf["c"].sum())], "mean": [mean], "low": [low], "high": [high]})

    return h.groupBy("adapter").applyInPandas(run, "adapter string, n long, mean double, low double, high double")


def x2_cluster_bootstrap(spark: SparkSession, sf_dir: str, draws: int = 1000) -> DataFrame:
    """Intervals of completion with buildings resampled: every building gets Poisson weights from its name, weighted sums add up
    across tasks, and the quantiles are taken over the draws."""
    per = joined(spark, sf_dir).where("building is not null").groupBy("adapter", "building").agg(F.sum("done").alias("d"), F.count("*").alias("n"))
    per = per.withColumn("seed", F.abs(F.xxhash64("building")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for adapter, d, n, seed in zip(*(b.column(c).to_pylist() for c in ("adapter", "d", "n", "seed"))):
                w = kernels.cluster_weights(seed, draws)
                sums.setdefault(adapter, np.zeros((2, draws)))
                sums[adapter] += np.vstack([w * d, w * n])
        for adapter, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([adapter] * draws), pa.array(range(draws), pa.int32()), pa.array(s[0]), pa.array(s[1])], names=["adapter", "draw", "d", "n"])

    rows = per.select("adapter", "d", "n", "seed").mapInArrow(run, "adapter string, draw int, d double, n double").groupBy("adapter", "draw").agg((F.sum("d") / F.sum("n")).alias("m"))
    return rows.groupBy("adapter").agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def x6_score_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score interval and the equivalence test for every two adapters; one row per pair of adapters."""
    @F.pandas_udf("low double, high double, p double, z_at_5 double")
    def score(b: pd.Series, c: pd.Series, n: pd.Series) -> pd.DataFrame:
        low, high = kernels.paired_score_interval(b, c, n)
        return pd.DataFrame({"low": low, "high": high, "p": kernels.equivalence_p(b, c, n, 0.05), "z_at_5": kernels.paired_score(b, c, n, 0.05)})

    return a15_contingency(spark, sf_dir).select("a", "b", score("n12", "n21", "n").alias("t")).select("a", "b", "t.*")


def x11_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and t interval of experience per request group; groups are a handful, their sums come from Spark."""
    @F.pandas_udf(DoubleType())
    def quantile(n: pd.Series) -> pd.Series:
        return n.map(lambda x: kernels.student_quantile(0.975, int(x) - 1) if x > 1 else None)

    g = table(spark, sf_dir, "request_props").where("years_experience is not null and not isnan(years_experience)").groupBy("grp").agg(F.count("*").alias("n"), F.avg("years_experience").alias("mean"), F.stddev_samp("years_experience").alias("sd"))
    return g.select("grp", "n", "mean", (quantile("n") * F.col("sd") / F.sqrt("n")).alias("half"))


def z2_capped_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300 places over operation and category, none above 60: strata are labels, at most sixteen rows on the driver."""
    rows = pool(spark, sf_dir).where("operation is not null and category is not null").groupBy("operation", "category").agg(F.count("*").alias("n")).orderBy("operation", "category").collect()
    quota = kernels.capped_quota([r["n"] for r in rows], [60] * len(rows), 300)
    return spark.createDataFrame([(r["operation"], r["category"], r["n"], q) for r, q in zip(rows, quota)], "operation string, category string, n long, quota int")


def z8_water_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of 400 accepted tasks shared by runs, none beyond what it has; one row per run, as the funnel has."""
    rows = table(spark, sf_dir, "funnel").where("n_accepted is not null").select("run_id", "n_accepted").orderBy("run_id").collect()
    share = kernels.water_fill([float(r["n_accepted"]) for r in rows], 400.0)
    return spark.createDataFrame([(r["run_id"], s) for r, s in zip(rows, share)], "run_id string, share double")


def z9_least_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs over four machines by their CPU seconds, the longest first."""
    rows = table(spark, sf_dir, "funnel").select("run_id", F.coalesce("cpu_seconds", F.lit(0.0)).alias("w")).orderBy("run_id").collect()
    return spark.createDataFrame([(r["run_id"], b) for r, b in zip(rows, kernels.least_loaded([r["w"] for r in rows], 4))], "run_id string, machine int")


def g21_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of input and output tokens per adapter; none for fewer than three runs."""
    return results(spark, sf_dir).groupBy("adapter").agg(F.when(F.count("input_tokens") >= 3, F.corr(F.col("input_tokens").cast("double"), F.col("output_tokens").cast("double"))).alias("r"))


def g9_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed runs that pass a gate on relations (topology 0.95), those lost, and rows without a score."""
    gate = F.coalesce(F.col("score.topology") >= 0.95, F.lit(False))
    return results(spark, sf_dir).groupBy("adapter").agg(F.count_if(completed()).alias("completed"), F.count_if(completed() & gate).alias("passed"), F.count_if(completed() & ~gate).alias("lost"), F.count_if(F.col("score.topology").isNull()).alias("no_gate"))



_GUIDS = "list_distinct(regexp_extract_all(text, '(?:^|[^0-9A-Za-z_$])([0-3][0-9A-Za-z_$]{21})(?:$|[^0-9A-Za-z_$])', 1))"
_RAW = "greatest(-0.2::DOUBLE, least(1.0::DOUBLE, coalesce((coalesce(score.final, 0.0) - coalesce(u, 0.0)) / nullif(1 - coalesce(u, 0.0), 0.0), 0.0)))"

QUERIES = {
    "ref_g9_gate": g9_gate, "ref_g21_gap": g21_gap,
    "ref_t1_observed_before_use": t1_observed_before_use, "ref_t7_call_status": t7_call_status, "ref_t9_kind_purity": t9_kind_purity, "ref_t10_coverage": t10_coverage, "ref_t11_rewards": t11_rewards, "ref_t12_key_coverage": t12_key_coverage,
    "ref_t13_preference_pairs": t13_preference_pairs, "ref_t14_first_failure": t14_first_failure, "ref_t15_class_shares": t15_class_shares, "ref_t16_assembly": t16_assembly, "ref_t17_harvest": t17_harvest, "ref_t19_audit": t19_audit,
    "ref_x1_bootstrap": x1_bootstrap, "ref_x2_cluster_bootstrap": x2_cluster_bootstrap, "ref_x6_score_intervals": x6_score_intervals, "ref_x11_writers": x11_writers,
    "ref_z2_capped_quota": z2_capped_quota, "ref_z8_water_fill": z8_water_fill, "ref_z9_least_loaded": z9_least_loaded,
}
SQL = {
    "ref_g21_gap": f"WITH {RESULTS} SELECT adapter, CASE WHEN count(input_tokens) >= 3 THEN corr(input_tokens::DOUBLE, output_tokens::DOUBLE) END AS r FROM r GROUP BY adapter",
    "ref_g9_gate": f"WITH {RESULTS}, g AS (SELECT *, coalesce(score.topology >= 0.95, false) AS g FROM r) SELECT adapter, count(*) FILTER ({DONE}) AS completed, count(*) FILTER ({DONE} AND g) AS passed, count(*) FILTER ({DONE} AND NOT g) AS lost, count(*) FILTER (score.topology IS NULL) AS no_gate FROM g GROUP BY adapter",
    "ref_t1_observed_before_use": f"WITH {CALLS}, s AS (SELECT user_id, key, min(struct_pack(t := ts, i := event_id)) AS seen FROM e WHERE event_type <> 'error' GROUP BY ALL) SELECT user_id, count(*) AS unobserved FROM e LEFT JOIN s USING (user_id, key) WHERE event_type = 'error' AND (seen IS NULL OR seen > struct_pack(t := ts, i := event_id)) GROUP BY user_id",
    "ref_t7_call_status": f"WITH {RESULTS} SELECT adapter, sum(tool_calls)::BIGINT AS calls, sum(tool_calls - well_formed_calls)::BIGINT AS malformed, sum(well_formed_calls - running_calls)::BIGINT AS raised, sum(commits)::BIGINT AS commits FROM r GROUP BY adapter",
    "ref_t9_kind_purity": "WITH l AS (SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10), u AS (SELECT user_id, bool_and(event_type = 'error') AS a, bool_or(event_type = 'error') AS s FROM l GROUP BY user_id) SELECT CASE WHEN a THEN 'all' WHEN s THEN 'some' ELSE 'none' END AS errors, count(*) AS n FROM u GROUP BY ALL",
    "ref_t10_coverage": f"WITH {POOL}, k AS (SELECT DISTINCT rec_id, edit_kind FROM task) SELECT edit_kind, count(*) FILTER (rec_id IN (SELECT rec_id FROM p)) AS n_train, count(*) AS n FROM k WHERE edit_kind IS NOT NULL GROUP BY edit_kind",
    "ref_t11_rewards": f"""WITH {RESULTS}, n AS (SELECT task_id, max(verification.null_edit_score) AS u FROM task WHERE task_id IS NOT NULL GROUP BY task_id), w AS (SELECT adapter, task_id, {_RAW} AS raw, committed, coalesce(tool_calls - running_calls, 0) AS e FROM r JOIN n USING (task_id))
    SELECT adapter, task_id, floor(raw * 1000000 + 0.5)::BIGINT AS raw, floor((CASE WHEN coalesce(committed, false) THEN raw - least(0.1::DOUBLE, 0.02::DOUBLE * e) ELSE least(0.0::DOUBLE, raw - least(0.1::DOUBLE, 0.02::DOUBLE * e)) END) * 1000000 + 0.5)::BIGINT AS shaped FROM w""",
    "ref_t12_key_coverage": f"WITH {RECORDS}, q AS (SELECT coalesce(prompt, instruction) AS text, list_distinct(target.guids) AS g FROM t WHERE coalesce(prompt, instruction) IS NOT NULL AND target.guids IS NOT NULL) SELECT len(g)::INT AS required, len(list_intersect(g, {_GUIDS}))::INT AS named, count(*) AS n FROM q GROUP BY ALL",
    "ref_t13_preference_pairs": f"""WITH {RESULTS}, f AS (SELECT task_id, adapter, score.final AS final, running_calls < tool_calls AS raised FROM r WHERE score.final IS NOT NULL), b AS (SELECT task_id, adapter AS chosen, final AS top FROM f QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY final DESC, adapter) = 1),
    x AS (SELECT f.*, chosen, top FROM f JOIN b USING (task_id) WHERE top >= 0.5 AND adapter <> chosen AND (top - final >= 0.3 OR (raised AND final < top))) SELECT task_id, chosen, adapter AS rejected, row_number() OVER (PARTITION BY task_id ORDER BY raised DESC NULLS LAST, final, adapter)::INT AS rank FROM x QUALIFY rank <= 2""",
    "ref_t14_first_failure": f"WITH {CALLS} SELECT user_id, key, arg_min(event_id, struct_pack(t := ts, i := event_id)) AS first_event, count(*) - 1 AS later FROM e WHERE event_type = 'error' GROUP BY user_id, key",
    "ref_t15_class_shares": "SELECT stage, reason, count(*) AS n, count(*)::DOUBLE / (sum(count(*)) OVER (PARTITION BY stage))::DOUBLE AS share FROM outcome GROUP BY stage, reason",
    "ref_t16_assembly": f"""WITH {POOL}, x AS (SELECT p.*, coalesce(prompt, instruction) AS text FROM p JOIN (SELECT rec_id, prompt, instruction FROM t) USING (rec_id)), c AS (SELECT *, row_number() OVER (PARTITION BY model, text ORDER BY created_at, rec_id) AS copy FROM x)
    SELECT CASE WHEN text IS NULL THEN 'no text' WHEN copy > 1 THEN 'repeated' WHEN building IS NULL THEN 'no building' WHEN length(text) > 300 THEN 'too long' ELSE 'kept' END AS why, count(*) AS n, max(length(text))::INT AS longest FROM c GROUP BY ALL""",
    "ref_t19_audit": f"WITH {RESULTS} SELECT adapter, count(*) FILTER (regexp_matches(reply, '(?i)[a-z0-9_]+/[a-z0-9_]+\\.[a-z0-9]+')) AS paths, count(*) FILTER (regexp_matches(reply, '(\\.\\./|/etc/|/root/)')) AS outside, count(*) FILTER (reply IS NULL) AS silent FROM r GROUP BY adapter",
}
