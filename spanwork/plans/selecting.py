"""Queries that select: quotas, round robin, repair, caps, runs, ranks, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwork.functions import labels
from spanwork.operators import selection as sel
from spanwork.operators import sets
from spanwork.plans.base import BUILDING, CATEGORY, MODEL, OPERATION, RECORDS, RESULTS, SPLIT, TASKS, VERSION, records, results, tasks
from spanwork.sources.tables import table

MD5 = "md5(concat_ws('|', '7', {0}::VARCHAR))"


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train records with clean labels."""
    rows = records(spark, sf_dir, "task_id", "operation", "category", "split", "building_id", "ifc_version", "families", "tier", "origin", "input_ifc", "clarification", "created_at")
    return rows.where(labels.split(F.col("split")) == "train").select(
        "rec_id", "task_id", "families", "tier", "origin", "clarification", "created_at",
        labels.operation(F.col("operation")).alias("operation"),
        labels.category(F.col("category")).alias("category"),
        labels.ifc_version(F.col("ifc_version")).alias("version"),
        labels.code(F.col("building_id")).alias("building"),
        labels.model_key(F.col("input_ifc")).alias("model"),
    )


POOL = f"""{RECORDS}, p AS (SELECT rec_id, task_id, families, tier, origin, clarification, created_at, {OPERATION} AS operation, {CATEGORY} AS category, {VERSION} AS version, {BUILDING} AS building, {MODEL} AS model
  FROM t WHERE {SPLIT} = 'train')"""


def z1_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = pool(spark, sf_dir).groupBy("operation", "category").agg(F.count("*").alias("n"))
    return sel.largest_remainder(counts, "n", 500, "operation", "category")


def z3_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotas = z1_quota(spark, sf_dir).where("operation is not null and category is not null")
    return sel.take_quota(pool(spark, sf_dir), quotas, ["operation", "category"], "rec_id").select("rec_id", "operation", "category", "depth")


def w1_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sel.round_robin(pool(spark, sf_dir), ["operation", "category"], "rec_id", 200).select("rec_id", "operation", "category", "depth")


def z4_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places per operation by weight, filled round robin over categories; shortfall per operation."""
    weights = {"create": 900, "update": 600, "delete": 1500}
    want = F.create_map(*[F.lit(x) for p in weights.items() for x in p])[F.col("operation")]
    rows = pool(spark, sf_dir).where("operation is not null").withColumn("d", sel.depth(["operation", "category"], sel.hash_order(7, "rec_id"), "rec_id"))
    order = Window.partitionBy("operation").orderBy("d", "category", "rec_id")
    taken = rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= want)
    return taken.groupBy("operation").agg(F.count("*").alias("n"), (F.max(want) - F.count("*")).alias("missing"))


def z5_prefer_low_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cell ten records, those without a clarification first, then single ones, then by hash."""
    first = F.when(F.col("clarification").isNull(), 0).otherwise(1)
    rn = sel.depth(["operation", "category"], first, (F.col("tier") != "single").cast("int"), sel.hash_order(7, "rec_id"), "rec_id")
    return pool(spark, sf_dir).where("operation is not null and category is not null").withColumn("rn", rn).where("rn <= 10").select("rec_id", "operation", "category", "rn")


def z7_top_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty more records, round robin over cells, from what an earlier selection left."""
    rest = pool(spark, sf_dir).join(w1_round_robin(spark, sf_dir).select("rec_id"), "rec_id", "left_anti")
    return sel.round_robin(rest, ["operation", "category"], "rec_id", 50).select("rec_id", "operation", "category", "depth")


def z10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of at most 40 records of one building."""
    rows = sel.chunked(pool(spark, sf_dir).where("building is not null"), "building", ["rec_id"], 40)
    return rows.groupBy("building", "chunk").agg(F.count("*").alias("n"), F.min("rec_id").alias("first"), F.max("rec_id").alias("last"))


def z11_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one record per building and cell and at most two per building."""
    rows = pool(spark, sf_dir).where("building is not null and operation is not null")
    one = rows.withColumn("a", sel.depth(["building", "operation", "category"], sel.hash_order(7, "rec_id"), "rec_id")).where("a = 1")
    return one.withColumn("b", sel.depth(["building"], sel.hash_order(7, "rec_id"), "rec_id")).where("b <= 2").select("building", "rec_id", "b")


def z12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a clarification leave a selection and records of their operation without one replace them."""
    rows = pool(spark, sf_dir).where("operation is not null").select("rec_id", "operation", F.col("clarification").isNotNull().alias("asks"))
    kept = sel.take_quota(rows, rows.groupBy("operation").agg(F.lit(100).alias("quota")), ["operation"], "rec_id").select("rec_id", "operation")
    return sel.repair(kept, rows.where("not asks").select("rec_id", "operation"), rows.where("asks").select("rec_id"), "operation", "rec_id")


def z13_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the records of one task id the first delivered one counts; tasks that failed are left out."""
    rows = pool(spark, sf_dir).where("task_id is not null")
    first = rows.withColumn("n", sel.depth(["task_id"], "created_at", "rec_id")).where("n = 1")
    return first.join(table(spark, sf_dir, "outcome").select("task_id"), "task_id", "left_anti").select("task_id", "rec_id")


def z14_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a selection: rows, distinct ids, buildings and models, per operation and overall."""
    rows = z3_stratified_sample(spark, sf_dir).select("rec_id").join(pool(spark, sf_dir), "rec_id")
    return rows.rollup("operation").agg(F.count("*").alias("n"), F.count_distinct("task_id").alias("ids"), F.count_distinct("building").alias("buildings"), F.count_distinct("model").alias("models"))


def z15_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages and reasons at which attempts were lost, with five ids each."""
    rows = table(spark, sf_dir, "outcome").withColumn("why", F.concat_ws(":", "stage", F.coalesce("reason", F.lit("unknown"))))
    return sel.with_examples(rows.select("task_id", "why").distinct(), "why", "task_id")


def x17_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "funnel")
    return r.select("run_id", (F.col("n_accepted") / F.col("n_attempted")).alias("accepted"), (F.col("n_attempted") - F.col("n_accepted")).alias("lost"), (F.col("n_accepted") / F.col("n_models_used")).alias("per_model"))


def z16_batch_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two checks of every supplier's batch of parts: members that nobody returned, and returned parts no finished order holds."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", "l_linestatus")
    pairs = lambda c: lines.where(c).select("l_suppkey", "l_partkey").distinct()
    batch, touched, allowed = pairs("true"), pairs("l_returnflag = 'R'"), pairs("l_linestatus = 'F'")
    missed = batch.join(touched, ["l_suppkey", "l_partkey"], "left_anti").withColumn("fault", F.lit("not_touched"))
    outside = touched.join(allowed, ["l_suppkey", "l_partkey"], "left_anti").withColumn("fault", F.lit("outside"))
    return missed.unionByName(outside).groupBy("l_suppkey", "fault").agg(F.count("*").alias("n"))


def w2_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sel.chunked(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], 3)
    return rows.select("o_custkey", "o_orderkey", "chunk", F.row_number().over(Window.partitionBy("chunk").orderBy("o_custkey", "rn")).alias("place"))


def w3_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one event type per user, cut after three events."""
    runs = sel.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type"))
    rn = F.row_number().over(Window.partitionBy("user_id", "island").orderBy("ts", "event_id"))
    return runs.withColumn("part", F.floor((rn - 1) / 3)).groupBy("user_id", "island", "part").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def w4_longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = sel.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type")).groupBy("user_id", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").alias("longest"))


def w5_repeat_after_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that repeat a call (same props) that failed earlier for the user."""
    e = table(spark, sf_dir, "events").withColumn("key", F.get_json_object("props", "$.k"))
    before = Window.partitionBy("user_id", "key").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.max((F.col("event_type") == "error").cast("int")).over(before)
    return e.withColumn("failed", failed).where("failed = 1").groupBy("user_id").agg(F.count("*").alias("repeats"))


def w6_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third most expensive part of a brand, only if its price is clear of its neighbours by 0.2."""
    by = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    price = F.col("p_retailprice")
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.row_number().over(by).alias("rn"), (F.lag(price).over(by) - price).alias("above"), (price - F.lead(price).over(by)).alias("below"))
    return rows.where("rn = 3 and above >= 0.2 and (below is null or below >= 0.2)").select("p_brand", "p_partkey")


def w8_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advantage over the group in whole cents times the group's size: exact, no mean is rounded."""
    e = table(spark, sf_dir, "events").withColumn("cents", F.floor(F.col("value") * 100).cast("long"))
    g = Window.partitionBy("user_id")
    return e.select("event_id", (F.col("cents") * F.count("*").over(g) - F.sum("cents").over(g)).alias("advantage_n"))


def w9_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose rewards do not differ teach nothing and go."""
    g = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), (F.max("value") - F.min("value")).alias("spread"))
    return g.groupBy((F.col("spread") < 1e-9).alias("flat")).agg(F.count("*").alias("groups"), F.sum("n").alias("rows"))


def w10_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand listed while their names fit into 400 characters."""
    by = Window.partitionBy("p_brand").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "part").withColumn("used", F.sum(F.length("p_name")).over(by)).where("used < 400")
    return rows.groupBy("p_brand").agg(F.count("*").alias("n"), F.max("used").alias("used"))


def w12_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First record of each source model and request; the others are repeats."""
    rows = records(spark, sf_dir, "input_ifc", "prompt", "instruction", "created_at").select("rec_id", "created_at", labels.model_key(F.col("input_ifc")).alias("model"), F.coalesce("prompt", "instruction").alias("text"))
    rows = rows.where("model is not null and text is not null").withColumn("n", sel.depth(["model", "text"], "created_at", "rec_id"))
    return rows.groupBy((F.col("n") == 1).alias("first")).agg(F.count("*").alias("n"))


def w13_next_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next higher and lower distinct size per brand."""
    sizes = table(spark, sf_dir, "part").select("p_brand", "p_size").distinct()
    by = Window.partitionBy("p_brand").orderBy("p_size")
    return sizes.select("p_brand", "p_size", F.lag("p_size").over(by).alias("below"), F.lead("p_size").over(by).alias("above"))


def w15_next_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First free number of each customer's sequence 1, 2, ... of order sizes."""
    n = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("int").alias("q")).distinct()
    gap = n.withColumn("rn", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("q"))).where("q = rn")
    every = n.select("l_orderkey").distinct()
    top = gap.groupBy("l_orderkey").agg(F.max("q").alias("top"))
    return every.join(top, "l_orderkey", "left").select("l_orderkey", (F.coalesce("top", F.lit(0)) + 1).alias("free"))


#: Two runs that are compared key by key.
BEFORE, AFTER = "base-9b", "grpo-c20"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What two adapters did, by task."""
    r = results(spark, sf_dir).select("adapter", "task_id", "stop_reason", "committed", "commits")
    return tuple(r.where(F.col("adapter") == a).drop("adapter") for a in (BEFORE, AFTER))


SNAPSHOTS = f"""{RESULTS}, a AS (SELECT task_id, stop_reason, committed, commits FROM r WHERE adapter = '{BEFORE}'), b AS (SELECT task_id, stop_reason, committed, commits FROM r WHERE adapter = '{AFTER}'),
d AS (SELECT task_id, CASE WHEN a.m IS NULL THEN 'created' WHEN b.m IS NULL THEN 'deleted' ELSE 'modified' END AS status, CASE WHEN a.m IS NULL OR b.m IS NULL THEN []::VARCHAR[] ELSE list_filter(['stop_reason', 'committed', 'commits'], lambda x: (x = 'stop_reason' AND a.stop_reason IS DISTINCT FROM b.stop_reason) OR
  (x = 'committed' AND a.committed IS DISTINCT FROM b.committed) OR (x = 'commits' AND a.commits IS DISTINCT FROM b.commits)) END AS changed FROM (SELECT *, 1 AS m FROM a) a FULL JOIN (SELECT *, 1 AS m FROM b) b USING (task_id)), e AS (SELECT * FROM d WHERE status <> 'modified' OR len(changed) > 0)"""


def u4_keyed_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _snapshots(spark, sf_dir)
    return sets.keyed_diff(a, b, ["task_id"], ["stop_reason", "committed", "commits"])


def u6_off_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of tasks outside those of one operation, per category; creations and deletions of one category cancel out."""
    k = tasks(spark, sf_dir).select("task_id", "operation", "category")
    diff = u4_keyed_diff(spark, sf_dir).join(k, "task_id")
    return sets.off_target(diff, k.where("operation = 'update'"), ["task_id"], "category")


def u7_edit_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counts as edited, by mode (the operation): added for create, removed for delete, both and what was modified for update."""
    d = u4_keyed_diff(spark, sf_dir).join(tasks(spark, sf_dir).select("task_id", F.col("operation").alias("mode")), "task_id")
    want = ((F.col("mode") == "delete") & (F.col("status") == "deleted")) | ((F.col("mode") == "create") & (F.col("status") == "created")) | (F.col("mode") == "update")
    return d.where(want).groupBy("mode", "status").agg(F.count("*").alias("n"))


def j19_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of returned lines beyond those of accepted ones, with multiplicity."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", F.col("l_quantity").cast("int").alias("quantity"))
    side = lambda f: lines.where(F.col("l_returnflag") == f).drop("l_returnflag")
    return sets.multiset_except(side("R"), side("A"))


def j8_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first run with the second's rows in their place where the second committed."""
    a, b = _snapshots(spark, sf_dir)
    return sets.upsert(a, b.where("committed"), ["task_id"]).groupBy("stop_reason").agg(F.count("*").alias("n"), F.sum("commits").alias("commits"))


def j4_j5_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with and without orders."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    some = c.join(o, "c_custkey", "left_semi").agg(F.count("*").alias("n")).withColumn("kind", F.lit("with"))
    return some.unionByName(c.join(o, "c_custkey", "left_anti").agg(F.count("*").alias("n")).withColumn("kind", F.lit("without")))


def j6_triple_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records whose building, element and operation also stand in train, with the number of such train records."""
    rows = records(spark, sf_dir, "split", "operation", "building_id", "target").select(
        "rec_id", labels.split(F.col("split")).alias("split"), labels.operation(F.col("operation")).alias("operation"), labels.code(F.col("building_id")).alias("building"), F.explode("target.guids").alias("guid")
    ).where("split is not null and operation is not null and building is not null").distinct()
    train = rows.where("split = 'train'").groupBy("building", "guid", "operation").agg(F.count_distinct("rec_id").alias("n"))
    return rows.where("split <> 'train'").join(train, ["building", "guid", "operation"]).groupBy("split", "rec_id").agg(F.sum("n").alias("n"))


def u3_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings in more than one split."""
    rows = records(spark, sf_dir, "split", "building_id").select(labels.split(F.col("split")).alias("split"), labels.code(F.col("building_id")).alias("building"))
    return rows.where("split is not null and building is not null").groupBy("building").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def a22_overlap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task ids of each split that also stand in each other table."""
    ids = records(spark, sf_dir, "split", "task_id").select(labels.split(F.col("split")).alias("split"), "task_id").where("split is not null and task_id is not null").distinct()
    refs = sets.union_all(
        table(spark, sf_dir, "task_result").select("task_id", F.lit("result").alias("ref")),
        table(spark, sf_dir, "outcome").select("task_id", F.lit("outcome").alias("ref")),
        table(spark, sf_dir, "request_props").select(F.col("base_task_id").alias("task_id"), F.lit("request").alias("ref")),
    ).distinct()
    return ids.join(refs, "task_id").groupBy("split").pivot("ref", ["outcome", "request", "result"]).agg(F.count(F.lit(1))).fillna(0)


def p12_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New ids: brand and a running number of four digits."""
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), F.lit("-"), F.lpad(n, 4, "0")).alias("new_id"))


def p10_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("/", *[F.coalesce(c, F.lit("none")) for c in ("operation", "category", "version", "tier")])
    return pool(spark, sf_dir).groupBy(key.alias("stratum")).agg(F.count("*").alias("n"))


def p8_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source models with enough records and operations, under new short keys by size."""
    m = pool(spark, sf_dir).where("model is not null").groupBy("model").agg(F.count("*").alias("n"), F.count_distinct("operation").alias("ops")).where("n >= 5 and ops >= 2")
    ranked = sel.global_rank(spark, m.select("model", "n"), "rank", F.desc("n"), "model")
    return ranked.select("model", "n", F.concat(F.lit("B"), F.lpad(F.col("rank").cast("string"), 4, "0")).alias("short_key"))


def p3_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reason per record, the first that applies; eligible without one."""
    c = records(spark, sf_dir, "split", "operation", "input_ifc", "prompt", "instruction", "clarification")
    why = sel.first_reason([
        (labels.split(F.col("split")).isNull(), "no split"), (labels.model_key(F.col("input_ifc")).isNull(), "no model"),
        (F.coalesce("prompt", "instruction").isNull(), "no text"), (labels.operation(F.col("operation")).isNull(), "no operation"), (F.col("clarification").isNotNull(), "asks back"),
    ])
    return sel.with_examples(c.withColumn("why", F.coalesce(why, F.lit("eligible"))), "why", "rec_id")


def p5_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open size tiers."""
    n = F.length("text")
    tier = F.when(n < 200, "small").when(n < 1000, "medium").when(n < 5000, "large").otherwise("huge")
    return table(spark, sf_dir, "documents").where("text is not null").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.max(n).alias("most"))


def p6_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags on nested fields: tagged in millimetres, refers by direct name, has more than one target."""
    return pool_raw(spark, sf_dir).agg(
        F.count_if(F.array_contains("families", "model.units.mm")).alias("mm"), F.count_if(F.exists("families", lambda f: f.startswith("ref."))).alias("with_reference"),
        F.count_if(F.size("target.guids") > 1).alias("many"), F.count_if(F.col("clarification.slot").isNull()).alias("clear"),
    )


def pool_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, "families", "target", "clarification")


def p7_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest layer of a record's families: the first of a fixed order that is present."""
    layers = F.array_distinct(F.transform("families", lambda f: F.split_part(f, F.lit("."), F.lit(1))))
    kind = F.coalesce(*[F.when(F.array_contains(layers, x), F.lit(x)) for x in ("wording", "model", "op", "ref")], F.lit("none"))
    return pool_raw(spark, sf_dir).groupBy(kind.alias("layer")).agg(F.count("*").alias("n"))


def p11_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring settings by tag: records in millimetres get another tolerance, compositional ones another weight."""
    tolerance = F.when(F.array_contains("families", "model.units.mm"), 5).otherwise(10)
    return pool(spark, sf_dir).groupBy(tolerance.alias("tolerance"), F.when(F.col("tier") == "compositional", 2).otherwise(1).alias("weight")).agg(F.count("*").alias("n"))


def a21_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: accepted and lost attempts against what was attempted, and records that were delivered."""
    got = records(spark, sf_dir, "run_id").groupBy("run_id").agg(F.count("*").alias("delivered"))
    lost = table(spark, sf_dir, "outcome").groupBy("run_id").agg(F.count("*").alias("rejected"))
    f = table(spark, sf_dir, "funnel").select("run_id", "n_attempted", "n_accepted")
    return f.join(got, "run_id", "full").join(lost, "run_id", "full").select("run_id", "n_attempted", "n_accepted", "delivered", "rejected", (F.col("n_attempted") - F.col("n_accepted") - F.coalesce("rejected", F.lit(0))).alias("unaccounted"))


def a14_top_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "outcome").where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(10)


def a9_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight widest gaps between neighbouring prices, within price bands so that no task sorts all."""
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_retailprice") * 100).cast("long").alias("cents")).distinct()
    band = F.floor(F.col("cents") / 10_000)
    inner = p.withColumn("band", band).withColumn("before", F.lag("cents").over(Window.partitionBy("band").orderBy("cents")))
    edge = p.groupBy(band.alias("band")).agg(F.min("cents").alias("lo"), F.max("cents").alias("hi"))
    across = edge.select(F.col("lo").alias("cents"), F.lag("hi").over(Window.partitionBy().orderBy("band")).alias("before"))  # one row per band
    gaps = inner.select("cents", "before").unionByName(across).where("before is not null").select("cents", (F.col("cents") - F.col("before")).alias("gap"))
    return gaps.orderBy(F.desc("gap"), "cents").limit(8)


def s3_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later deliveries replace earlier ones."""
    raw = table(spark, sf_dir, "task").agg(F.count("*").alias("delivered"))
    return records(spark, sf_dir, "split").agg(F.count("*").alias("kept")).crossJoin(raw)  # two single rows


def s16_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation tasks an adapter has not run yet."""
    todo = records(spark, sf_dir, "split", "task_id").where(labels.split(F.col("split")) != "train").select("task_id").where("task_id is not null").distinct()
    done = table(spark, sf_dir, "task_result").select("adapter", "task_id")
    every = done.select("adapter").distinct().crossJoin(F.broadcast(todo.agg(F.count("*").alias("n_todo"))))  # a row per adapter
    have = done.join(todo, "task_id", "left_semi").groupBy("adapter").agg(F.count_distinct("task_id").alias("n_done"))
    return every.join(have, "adapter", "left").select("adapter", (F.col("n_todo") - F.coalesce("n_done", F.lit(0))).alias("pending"))


_Z1 = f"""{POOL}, c AS (SELECT operation, category, count(*) AS n FROM p GROUP BY ALL), q AS (SELECT *, (n * 500) // sum(n) OVER ()::BIGINT AS w, (n * 500) % sum(n) OVER ()::BIGINT AS rest FROM c),
z AS (SELECT operation, category, n, (w + (row_number() OVER (ORDER BY rest DESC, operation NULLS FIRST, category NULLS FIRST) <= 500 - sum(w) OVER ())::BIGINT)::BIGINT AS quota FROM q)"""
_Z3 = f"""{_Z1}, s AS (SELECT p.*, quota, row_number() OVER (PARTITION BY operation, category ORDER BY {MD5.format('rec_id')}, rec_id)::INT AS depth FROM p JOIN z USING (operation, category))"""
_W1 = f"""{POOL}, d AS (SELECT rec_id, operation, category, row_number() OVER (PARTITION BY operation, category ORDER BY {MD5.format('rec_id')}, rec_id)::INT AS depth FROM p),
o AS (SELECT * FROM d ORDER BY depth, operation NULLS FIRST, category NULLS FIRST, rec_id LIMIT 200)"""
_ISLAND = """e AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER w)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS island FROM e)"""

QUERIES = {
    "ref_a9_gaps": a9_gaps, "ref_a14_top_reasons": a14_top_reasons, "ref_a21_accounting": a21_accounting, "ref_a22_overlap_matrix": a22_overlap_matrix,
    "ref_j4_j5_checks": j4_j5_checks, "ref_j6_triple_overlap": j6_triple_overlap, "ref_j8_upsert": j8_upsert, "ref_j19_multiset": j19_multiset,
    "ref_p3_eligibility": p3_eligibility, "ref_p5_buckets": p5_buckets, "ref_p6_flags": p6_flags, "ref_p7_layer": p7_layer, "ref_p8_candidates": p8_candidates, "ref_p10_strata": p10_strata, "ref_p11_settings": p11_settings, "ref_p12_relabel": p12_relabel,
    "ref_s3_latest": s3_latest, "ref_s16_pending": s16_pending,
    "ref_u3_disjoint": u3_disjoint, "ref_u4_keyed_diff": u4_keyed_diff, "ref_u6_off_target": u6_off_target, "ref_u7_edit_set": u7_edit_set,
    "ref_w1_round_robin": w1_round_robin, "ref_w2_chunked": w2_chunked, "ref_w3_runs": w3_runs, "ref_w4_longest_run": w4_longest_run, "ref_w5_repeat_after_error": w5_repeat_after_error, "ref_w6_ordinal": w6_ordinal,
    "ref_w8_centred": w8_centred, "ref_w9_flat": w9_flat, "ref_w10_budget": w10_budget, "ref_w12_first_seen": w12_first_seen, "ref_w13_next_above": w13_next_above, "ref_w15_next_number": w15_next_number,
    "ref_x17_yield": x17_yield,
    "ref_z1_quota": z1_quota, "ref_z3_stratified_sample": z3_stratified_sample, "ref_z4_weighted_mix": z4_weighted_mix, "ref_z5_prefer_low_floor": z5_prefer_low_floor, "ref_z7_top_up": z7_top_up, "ref_z10_shards": z10_shards,
    "ref_z11_capped": z11_capped, "ref_z12_repair": z12_repair, "ref_z13_canonical": z13_canonical, "ref_z14_manifest": z14_manifest, "ref_z15_funnel": z15_funnel, "ref_z16_batch_scope": z16_batch_scope,
}
SQL = {
    "ref_a9_gaps": "WITH p AS (SELECT DISTINCT floor(p_retailprice * 100)::BIGINT AS cents FROM part), g AS (SELECT cents, cents - lag(cents) OVER (ORDER BY cents) AS gap FROM p) SELECT * FROM g WHERE gap IS NOT NULL ORDER BY gap DESC, cents LIMIT 8",
    "ref_a14_top_reasons": "SELECT reason, count(*) AS n FROM outcome WHERE reason IS NOT NULL GROUP BY reason ORDER BY n DESC, reason LIMIT 10",
    "ref_a21_accounting": f"""WITH {RECORDS}, g AS (SELECT run_id, count(*) AS delivered FROM t GROUP BY run_id), l AS (SELECT run_id, count(*) AS rejected FROM outcome GROUP BY run_id)
    SELECT run_id, n_attempted, n_accepted, delivered, rejected, n_attempted - n_accepted - coalesce(rejected, 0) AS unaccounted FROM funnel FULL JOIN g USING (run_id) FULL JOIN l USING (run_id)""",
    "ref_a22_overlap_matrix": f"""WITH {RECORDS}, i AS (SELECT DISTINCT {SPLIT} AS split, task_id FROM t WHERE {SPLIT} IS NOT NULL AND task_id IS NOT NULL)
    SELECT split, count(*) FILTER (task_id IN (SELECT task_id FROM outcome WHERE task_id IS NOT NULL)) AS outcome, count(*) FILTER (task_id IN (SELECT base_task_id FROM request_props WHERE base_task_id IS NOT NULL)) AS request, count(*) FILTER (task_id IN (SELECT task_id FROM task_result WHERE task_id IS NOT NULL)) AS result FROM i GROUP BY split""",
    "ref_j4_j5_checks": "SELECT 'with' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'without', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "ref_j6_triple_overlap": f"""WITH {RECORDS}, x AS (SELECT DISTINCT rec_id, {SPLIT} AS split, {OPERATION} AS operation, {BUILDING} AS building, unnest(target.guids) AS guid FROM t), y AS (SELECT * FROM x WHERE split IS NOT NULL AND operation IS NOT NULL AND building IS NOT NULL),
    n AS (SELECT building, guid, operation, count(DISTINCT rec_id) AS n FROM y WHERE split = 'train' GROUP BY ALL) SELECT split, rec_id, sum(n)::BIGINT AS n FROM y JOIN n USING (building, guid, operation) WHERE split <> 'train' GROUP BY ALL""",
    "ref_j8_upsert": f"""WITH {SNAPSHOTS}, n AS (SELECT * FROM b WHERE committed), u AS (SELECT * FROM a WHERE task_id NOT IN (SELECT task_id FROM n) UNION ALL SELECT * FROM n) SELECT stop_reason, count(*) AS n, sum(commits)::BIGINT AS commits FROM u GROUP BY stop_reason""",
    "ref_j19_multiset": """SELECT l_linestatus, l_linenumber, quantity, count(*) AS surplus FROM (SELECT l_linestatus, l_linenumber, l_quantity::INT AS quantity FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_linestatus, l_linenumber, l_quantity::INT FROM lineitem WHERE l_returnflag = 'A') GROUP BY ALL""",
    "ref_p3_eligibility": f"""WITH {RECORDS}, w AS (SELECT rec_id, CASE WHEN {SPLIT} IS NULL THEN 'no split' WHEN {MODEL} IS NULL THEN 'no model' WHEN coalesce(prompt, instruction) IS NULL THEN 'no text' WHEN {OPERATION} IS NULL THEN 'no operation' WHEN clarification IS NOT NULL THEN 'asks back' ELSE 'eligible' END AS why FROM t)
    SELECT why, count(*) AS n, list_sort(list(rec_id))[1:5] AS examples FROM w GROUP BY why""",
    "ref_p5_buckets": "SELECT CASE WHEN length(text) < 200 THEN 'small' WHEN length(text) < 1000 THEN 'medium' WHEN length(text) < 5000 THEN 'large' ELSE 'huge' END AS tier, count(*) AS n, max(length(text))::INT AS most FROM documents WHERE text IS NOT NULL GROUP BY ALL",
    "ref_p6_flags": f"""WITH {RECORDS} SELECT count(*) FILTER (list_contains(families, 'model.units.mm')) AS mm, count(*) FILTER (len(list_filter(families, lambda f: starts_with(f, 'ref.'))) > 0) AS with_reference, count(*) FILTER (len(target.guids) > 1) AS many, count(*) FILTER (clarification.slot IS NULL) AS clear FROM t""",
    "ref_p7_layer": f"""WITH {RECORDS}, l AS (SELECT list_transform(families, lambda f: split_part(f, '.', 1)) AS l FROM t) SELECT CASE WHEN list_contains(l, 'wording') THEN 'wording' WHEN list_contains(l, 'model') THEN 'model' WHEN list_contains(l, 'op') THEN 'op' WHEN list_contains(l, 'ref') THEN 'ref' ELSE 'none' END AS layer, count(*) AS n FROM l GROUP BY ALL""",
    "ref_p8_candidates": f"""WITH {POOL}, m AS (SELECT model, count(*) AS n, count(DISTINCT operation) AS ops FROM p WHERE model IS NOT NULL GROUP BY model HAVING count(*) >= 5 AND count(DISTINCT operation) >= 2) SELECT model, n, 'B' || lpad((row_number() OVER (ORDER BY n DESC, model))::VARCHAR, 4, '0') AS short_key FROM m""",
    "ref_p10_strata": f"WITH {POOL} SELECT concat_ws('/', coalesce(operation, 'none'), coalesce(category, 'none'), coalesce(version, 'none'), coalesce(tier, 'none')) AS stratum, count(*) AS n FROM p GROUP BY ALL",
    "ref_p11_settings": f"WITH {POOL} SELECT CASE WHEN list_contains(families, 'model.units.mm') THEN 5 ELSE 10 END AS tolerance, CASE WHEN tier = 'compositional' THEN 2 ELSE 1 END AS weight, count(*) AS n FROM p GROUP BY ALL",
    "ref_p12_relabel": "SELECT p_partkey, regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') || '-' || lpad((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey))::VARCHAR, 4, '0') AS new_id FROM part",
    "ref_s3_latest": "SELECT count(DISTINCT rec_id) AS kept, count(*) AS delivered FROM task",
    "ref_s16_pending": f"""WITH {RECORDS}, d AS (SELECT DISTINCT task_id FROM t WHERE {SPLIT} <> 'train' AND task_id IS NOT NULL) SELECT adapter, (SELECT count(*) FROM d) - count(DISTINCT task_id) FILTER (task_id IN (SELECT task_id FROM d)) AS pending FROM task_result GROUP BY adapter""",
    "ref_u3_disjoint": f"WITH {RECORDS} SELECT {BUILDING} AS building, count(DISTINCT {SPLIT}) AS splits FROM t WHERE {BUILDING} IS NOT NULL GROUP BY ALL HAVING count(DISTINCT {SPLIT}) > 1",
    "ref_u4_keyed_diff": f"WITH {SNAPSHOTS} SELECT task_id, status, changed FROM e",
    "ref_u6_off_target": f"""WITH {SNAPSHOTS}, {TASKS}, g AS (SELECT category, count(*) FILTER (status = 'created') AS c, count(*) FILTER (status = 'deleted') AS x, count(*) FILTER (status = 'modified') AS modified FROM e JOIN k USING (task_id) WHERE operation IS DISTINCT FROM 'update' GROUP BY ALL)
    SELECT category, c - least(c, x) AS created, x - least(c, x) AS deleted, modified FROM g""",
    "ref_u7_edit_set": f"""WITH {SNAPSHOTS}, {TASKS} SELECT operation AS mode, status, count(*) AS n FROM e JOIN k USING (task_id) WHERE (operation = 'delete' AND status = 'deleted') OR (operation = 'create' AND status = 'created') OR operation = 'update' GROUP BY ALL""",
    "ref_w1_round_robin": f"WITH {_W1} SELECT * FROM o",
    "ref_w2_chunked": """WITH c AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) SELECT o_custkey, o_orderkey, ((rn - 1) // 3)::INT AS chunk, row_number() OVER (PARTITION BY (rn - 1) // 3 ORDER BY o_custkey, rn)::INT AS place FROM c""",
    "ref_w3_runs": f"""WITH {_ISLAND}, r AS (SELECT *, (row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) - 1) // 3 AS part FROM i) SELECT user_id, island, part, count(*) AS n, min(event_id) AS "first" FROM r GROUP BY ALL""",
    "ref_w4_longest_run": f"WITH {_ISLAND}, r AS (SELECT user_id, island, count(*) AS n FROM i GROUP BY ALL) SELECT user_id, max(n) AS longest FROM r GROUP BY user_id",
    "ref_w5_repeat_after_error": """WITH e AS (SELECT *, max((event_type = 'error')::INT) OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM events) SELECT user_id, count(*) AS repeats FROM e WHERE f = 1 GROUP BY user_id""",
    "ref_w6_ordinal": """WITH r AS (SELECT p_brand, p_partkey, row_number() OVER w AS rn, lag(p_retailprice) OVER w - p_retailprice AS above, p_retailprice - lead(p_retailprice) OVER w AS below FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)) SELECT p_brand, p_partkey FROM r WHERE rn = 3 AND above >= 0.2 AND (below IS NULL OR below >= 0.2)""",
    "ref_w8_centred": "WITH e AS (SELECT *, floor(value * 100)::BIGINT AS cents FROM events) SELECT event_id, (cents * count(*) OVER g - sum(cents) OVER g)::BIGINT AS advantage_n FROM e WINDOW g AS (PARTITION BY user_id)",
    "ref_w9_flat": "WITH g AS (SELECT user_id, event_type, count(*) AS n, max(value) - min(value) AS spread FROM events GROUP BY ALL) SELECT spread < 1e-9 AS flat, count(*) AS groups, sum(n)::BIGINT AS \"rows\" FROM g GROUP BY ALL",
    "ref_w10_budget": "WITH u AS (SELECT p_brand, sum(length(p_name)) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM part) SELECT p_brand, count(*) AS n, max(used) AS used FROM u WHERE used < 400 GROUP BY p_brand",
    "ref_w12_first_seen": f"""WITH {RECORDS}, x AS (SELECT row_number() OVER (PARTITION BY {MODEL}, coalesce(prompt, instruction) ORDER BY created_at, rec_id) AS n FROM t WHERE {MODEL} IS NOT NULL AND coalesce(prompt, instruction) IS NOT NULL) SELECT n = 1 AS "first", count(*) AS n FROM x GROUP BY n = 1""",
    "ref_w13_next_above": "WITH s AS (SELECT DISTINCT p_brand, p_size FROM part) SELECT p_brand, p_size, lag(p_size) OVER w AS below, lead(p_size) OVER w AS above FROM s WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)",
    "ref_w15_next_number": """WITH n AS (SELECT DISTINCT l_orderkey, l_quantity::INT AS q FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY q) AS rn FROM n) SELECT l_orderkey, (coalesce(max(q) FILTER (q = rn), 0) + 1)::INT AS free FROM r GROUP BY l_orderkey""",
    "ref_x17_yield": "SELECT run_id, n_accepted::DOUBLE / n_attempted AS accepted, n_attempted - n_accepted AS lost, n_accepted::DOUBLE / n_models_used AS per_model FROM funnel",
    "ref_z1_quota": f"WITH {_Z1} SELECT * FROM z",
    "ref_z3_stratified_sample": f"WITH {_Z3} SELECT rec_id, operation, category, depth FROM s WHERE depth <= quota",
    "ref_z4_weighted_mix": f"""WITH {POOL}, d AS (SELECT *, row_number() OVER (PARTITION BY operation, category ORDER BY {MD5.format('rec_id')}, rec_id) AS d FROM p WHERE operation IS NOT NULL), w(operation, want) AS (VALUES ('create', 900), ('update', 600), ('delete', 1500)),
    n AS (SELECT operation, want, row_number() OVER (PARTITION BY operation ORDER BY d, category NULLS FIRST, rec_id) AS rn FROM d JOIN w USING (operation)) SELECT operation, count(*) AS n, max(want)::BIGINT - count(*) AS missing FROM n WHERE rn <= want GROUP BY operation""",
    "ref_z5_prefer_low_floor": f"""WITH {POOL}, d AS (SELECT rec_id, operation, category, row_number() OVER (PARTITION BY operation, category ORDER BY (clarification IS NOT NULL)::INT, (tier <> 'single')::INT NULLS FIRST, {MD5.format('rec_id')}, rec_id)::INT AS rn FROM p WHERE operation IS NOT NULL AND category IS NOT NULL) SELECT * FROM d WHERE rn <= 10""",
    "ref_z7_top_up": f"""WITH {_W1}, e AS (SELECT rec_id, operation, category, row_number() OVER (PARTITION BY operation, category ORDER BY {MD5.format('rec_id')}, rec_id)::INT AS depth FROM p WHERE rec_id NOT IN (SELECT rec_id FROM o)) SELECT * FROM e ORDER BY depth, operation NULLS FIRST, category NULLS FIRST, rec_id LIMIT 50""",
    "ref_z10_shards": f"""WITH {POOL}, c AS (SELECT building, rec_id, ((row_number() OVER (PARTITION BY building ORDER BY rec_id) - 1) // 40)::INT AS chunk FROM p WHERE building IS NOT NULL) SELECT building, chunk, count(*) AS n, min(rec_id) AS "first", max(rec_id) AS "last" FROM c GROUP BY ALL""",
    "ref_z11_capped": f"""WITH {POOL}, a AS (SELECT building, rec_id FROM p WHERE building IS NOT NULL AND operation IS NOT NULL QUALIFY row_number() OVER (PARTITION BY building, operation, category ORDER BY {MD5.format('rec_id')}, rec_id) = 1), b AS (SELECT building, rec_id, row_number() OVER (PARTITION BY building ORDER BY {MD5.format('rec_id')}, rec_id)::INT AS b FROM a) SELECT * FROM b WHERE b <= 2""",
    "ref_z12_repair": f"""WITH {POOL}, x AS (SELECT rec_id, operation, clarification IS NOT NULL AS asks, row_number() OVER (PARTITION BY operation ORDER BY {MD5.format('rec_id')}, rec_id) AS d FROM p WHERE operation IS NOT NULL), k AS (SELECT * FROM x WHERE d <= 100),
    h AS (SELECT operation, rec_id AS replaces, row_number() OVER (PARTITION BY operation ORDER BY {MD5.format('rec_id')}, rec_id) AS n FROM k WHERE asks), s AS (SELECT operation, rec_id, row_number() OVER (PARTITION BY operation ORDER BY {MD5.format('rec_id')}, rec_id) AS n FROM x WHERE NOT asks AND d > 100)
    SELECT rec_id, operation, NULL::BIGINT AS replaces FROM k WHERE NOT asks UNION ALL SELECT s.rec_id, operation, replaces FROM s JOIN h USING (operation, n)""",
    "ref_z13_canonical": f"""WITH {POOL} SELECT task_id, rec_id FROM p WHERE task_id IS NOT NULL AND task_id NOT IN (SELECT task_id FROM outcome WHERE task_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY created_at, rec_id) = 1""",
    "ref_z14_manifest": f"""WITH {_Z3} SELECT operation, count(*) AS n, count(DISTINCT task_id) AS ids, count(DISTINCT building) AS buildings, count(DISTINCT model) AS models FROM s WHERE depth <= quota GROUP BY ROLLUP (operation)""",
    "ref_z15_funnel": """WITH o AS (SELECT DISTINCT task_id, stage || ':' || coalesce(reason, 'unknown') AS why FROM outcome) SELECT why, count(*) AS n, list_sort(list(task_id))[1:5] AS examples FROM o GROUP BY why""",
    "ref_z16_batch_scope": """WITH b AS (SELECT l_suppkey, l_partkey, bool_or(l_returnflag = 'R') AS r, bool_or(l_linestatus = 'F') AS f FROM lineitem GROUP BY ALL) SELECT l_suppkey, 'not_touched' AS fault, count(*) AS n FROM b WHERE NOT r GROUP BY ALL
    UNION ALL SELECT l_suppkey, 'outside', count(*) FROM b WHERE r AND NOT f GROUP BY ALL""",
}
