"""Queries over elements, relations, boxes and candidate lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwork.functions import labels
from spanwork.operators import references as refs
from spanwork.operators import sets, spatial
from spanwork.plans.base import MODEL, RECORDS, SPLIT, records
from spanwork.sources.tables import table

ELEMENTS = "el AS (SELECT vec_id AS id, label AS storey, floor(embedding[1]::DOUBLE * 1000)::BIGINT AS x, floor(embedding[2]::DOUBLE * 1000)::BIGINT AS y, floor(embedding[3]::DOUBLE * 1000)::BIGINT AS z FROM embeddings)"
ANCHORS = f"{ELEMENTS}, an AS (SELECT id AS ref, storey, x AS ax, y AS ay, z AS az FROM el WHERE id % 50 = 0), n AS (SELECT * FROM an JOIN el USING (storey) WHERE id <> ref)"
EDGES = "ed AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem)"
_ONE = "SELECT ref, min(id) AS id FROM ({0}) GROUP BY ref HAVING count(*) = 1"


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: F.floor(F.col("embedding")[k].cast("double") * 1000)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("storey"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of a search: every id divisible by 50, against all elements."""
    return elements(spark, sf_dir).where("id % 50 = 0").select(F.col("id").alias("ref"), "storey", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


def resolve_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.unique(refs.nearest(anchors(spark, sf_dir), elements(spark, sf_dir), 100))


def resolve_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.offset(anchors(spark, sf_dir), elements(spark, sf_dir), 150, 120)


def resolve_extreme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.unique(refs.extreme(elements(spark, sf_dir), "x", 20))


def resolve_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = anchors(spark, sf_dir)
    pair = a.join(a.select("storey", F.col("ref").alias("other"), F.col("ax").alias("bx"), F.col("ay").alias("by")), "storey").where("ref < other")
    nxt = pair.withColumn("k", F.row_number().over(Window.partitionBy("ref").orderBy("other"))).where("k = 1")
    return refs.between(nxt, elements(spark, sf_dir), 100)


def resolve_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.above(anchors(spark, sf_dir), elements(spark, sf_dir), 200, 150)


def resolve_beside(spark: SparkSession, sf_dir: str) -> DataFrame:
    looks = anchors(spark, sf_dir).withColumn("dx", F.col("ax") - F.col("ay")).withColumn("dy", F.col("az"))
    return refs.beside(looks, elements(spark, sf_dir), 20_000).groupBy("ref").agg(F.count("*").alias("n"))


def resolve_opposite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.unique(refs.opposite(anchors(spark, sf_dir), elements(spark, sf_dir)))


def resolve_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.ordinal(elements(spark, sf_dir), "x", 3, 5)


def resolve_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.larger_than(elements(spark, sf_dir), "z", 100)


def resolve_bounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every two suppliers of neighbouring numbers, the parts that both sell: two edges from one source."""
    e = edges(spark, sf_dir)
    pairs = e.select(F.col("dst").alias("ref")).distinct().select("ref", (F.col("ref") + 1).alias("other"))
    return refs.related(e, pairs).groupBy("ref").agg(F.count("*").alias("n"), F.min("id").alias("least"))


def resolve_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 48").select(F.col("l_partkey").alias("src"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("storey"))
    return refs.unrelated(parts, some).groupBy("ref").agg(F.count("*").alias("n"))


def j17_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.knn(anchors(spark, sf_dir), elements(spark, sf_dir), 5)


def g24_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.within_distance(elements(spark, sf_dir).select("id", "x", "y"), 60)


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = elements(spark, sf_dir)
    return e.select("id", F.col("x").alias("x0"), (F.col("x") + 40 + F.abs("z") % 60).alias("x1"), F.col("y").alias("y0"), (F.col("y") + 30 + F.abs("z") % 50).alias("y1"))


BOXES = f"{ELEMENTS}, bx AS (SELECT id, x AS x0, x + 40 + abs(z) % 60 AS x1, y AS y0, y + 30 + abs(z) % 50 AS y1 FROM el)"


def j15_box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that collide, and the area they share."""
    b = _boxes(spark, sf_dir)
    rows = spatial.overlap_join(b, b, 100).where("a < b")
    area = (F.least("ax1", "bx1") - F.greatest("ax0", "bx0")) * (F.least("ay1", "by1") - F.greatest("ay0", "by0"))
    return rows.select("a", "b", area.alias("area"))


def j16_points_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points per box: a point is a box without extent."""
    p = elements(spark, sf_dir).select("id", F.col("x").alias("x0"), F.col("x").alias("x1"), F.col("y").alias("y0"), F.col("y").alias("y1"))
    return spatial.overlap_join(_boxes(spark, sf_dir), p, 100).groupBy("a").agg(F.count("*").alias("n"))


def g10_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [(f"{f}_{c}", getattr(F, f)(c)) for c in "xyz" for f in ("min", "max")]
    return elements(spark, sf_dir).groupBy("storey").agg(*[c.alias(n) for n, c in names])


def g22_in_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one storey on one line (y within 3) that lie one behind the other with a gap of at most 300."""
    e = elements(spark, sf_dir).withColumn("band", F.floor(F.col("y") / 3))
    a = e.select("storey", F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    rows = a.join(e, ["storey", "band"]).where("a < id and abs(y - ay) <= 3 and abs(x - ax) <= 300")
    return rows.select("storey", "a", F.col("id").alias("b"))


def g23_free_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free stretches of at least 30 between the intervals of a storey: next begin less the furthest end so far."""
    e = _boxes(spark, sf_dir).join(elements(spark, sf_dir).select("id", "storey"), "id")
    by = Window.partitionBy("storey").orderBy("x0", "id")
    end = F.max("x1").over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = e.select("storey", end.alias("from_x"), F.lead("x0").over(by).alias("to_x"))
    return rows.where("to_x - from_x >= 30")


def g25_unique_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name is unique within their brand."""
    n = F.count("*").over(Window.partitionBy("p_brand", "p_name"))
    return table(spark, sf_dir, "part").withColumn("n", n).where("n = 1").groupBy("p_brand").agg(F.count("*").alias("unique_names"))


def g26_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_distinct("p_type").alias("types"), F.count_distinct("p_size").alias("sizes"), F.min("p_size").alias("least"), F.max("p_size").alias("most"))


def g2_delta_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of accepted and of returned lines: how well one set reproduces the other, per supplier's nation."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation")), "l_suppkey")
    e = l.groupBy("nation", "l_partkey", "l_suppkey").agg(F.max((F.col("l_returnflag") == "A").cast("int")).alias("a"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("b"))
    s = e.groupBy("nation").agg(F.sum(F.col("a") * F.col("b")).alias("hit"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    p, r, f = sets.precision_recall(F.col("hit"), F.col("na"), F.col("nb"))
    return s.select("nation", "hit", (F.col("na") - F.col("hit")).alias("added"), (F.col("nb") - F.col("hit")).alias("removed"), p.alias("precision"), r.alias("recall"), f.alias("f1"))


def g4_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges under new ids where there is one: parts of one name are one part."""
    same = table(spark, sf_dir, "part").select("p_partkey", F.min("p_partkey").over(Window.partitionBy("p_name", "p_brand")).alias("new")).where("new <> p_partkey")
    e = edges(spark, sf_dir).join(same, F.col("src") == F.col("p_partkey"), "left").select(F.coalesce("new", "src").alias("src"), "dst").distinct()
    return e.groupBy("dst").agg(F.count("*").alias("n"))


def g7_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Referential checks as counts: results without task, requests without base task, outcomes without run."""
    ids = table(spark, sf_dir, "task").where("task_id is not null").select("task_id").distinct()
    bad = lambda df, name: df.join(ids, "task_id", "left_anti").agg(F.count("*").alias("n")).withColumn("kind", F.lit(name))
    runs = table(spark, sf_dir, "funnel").select("run_id")
    lost = table(spark, sf_dir, "outcome").where("run_id is not null").join(runs, "run_id", "left_anti").agg(F.count("*").alias("n")).withColumn("kind", F.lit("outcome"))
    requests = table(spark, sf_dir, "request_props").where("base_task_id is not null").select(F.col("base_task_id").alias("task_id"))
    return sets.union_all(bad(table(spark, sf_dir, "task_result").where("task_id is not null").select("task_id"), "result"), bad(requests, "request"), lost)


def g6_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors within eight steps in the tree where the parent of part k is k div 3."""
    steps = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("at"), F.lit(0).alias("depth"))
    found, here = None, steps
    for d in range(1, 9):  # eight projections, no join: the parent is computed
        here = here.select("id", F.floor(F.col("at") / 3).alias("at"), F.lit(d).alias("depth")).where("at > 0")
        found = here if found is None else found.unionByName(here)
    return found.groupBy("depth").agg(F.count("*").alias("n"), F.count_distinct("at").alias("ancestors"))


def j18_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score that spreads from part 1: 100 to its suppliers' parts (one hop, weight 0.3), 60 % of that along a second hop; the best
    path counts."""
    e = edges(spark, sf_dir)
    back = e.toDF("part", "dst")
    one = e.where("src = 1").join(back, "dst").where("part <> 1").select("part").distinct().withColumn("score", F.lit(30))
    two = one.join(e.toDF("part", "dst"), "part").select("dst").distinct().join(back, "dst").select("part").distinct().withColumn("score", F.lit(18))
    best = one.unionByName(two).where("part <> 1").groupBy("part").agg(F.max("score").alias("score"))
    return best.groupBy("score").agg(F.count("*").alias("n"))


def j13_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual nearest neighbours of a storey: pairs that any greedy matching by distance takes first."""
    k = refs.knn(elements(spark, sf_dir).select(F.col("id").alias("ref"), "storey", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az")), elements(spark, sf_dir), 1).select("ref", "id")
    return k.join(k.toDF("id", "ref"), ["ref", "id"]).where("ref < id").select("ref", "id")


def g17_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagonals of boxes that cross: only boxes that overlap can, so the grid join goes first."""
    b = _boxes(spark, sf_dir)
    rows = spatial.overlap_join(b, b, 100).where("a < b")
    rising = lambda p: tuple(F.col(p + c) for c in ("x0", "y0", "x1", "y1"))
    falling = lambda p: tuple(F.col(p + c) for c in ("x0", "y1", "x1", "y0"))
    return rows.where(spatial.segments_cross(rising("a"), falling("b"))).select("a", "b")


def r7_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for each anchor by place: points for the five nearest (10 down to 2), for lying above (6), at an offset (5) and to the east (8);
    from 10 points on, ten at most, ties by id."""
    a, e = anchors(spark, sf_dir), elements(spark, sf_dir)
    east = a.join(e, "storey").where("id <> ref and x > ax and abs(y - ay) <= x - ax").select("ref", "id", F.lit(8).alias("s"))
    near = refs.knn(a, e, 5).select("ref", "id", (12 - 2 * F.col("place")).alias("s"))
    parts = [near, refs.above(a, e, 200, 150).withColumn("s", F.lit(6)), refs.offset(a, e, 150, 120).withColumn("s", F.lit(5)), east]
    total = sets.union_all(*parts).groupBy("ref", "id").agg(F.sum("s").alias("score")).where("score >= 10")
    return total.withColumn("place", F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("score"), "id"))).where("place <= 10")


def r_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for each evaluation request out of the elements that requests of its source model name.

    A number named in the request scores 60, a name 80 if unique and 40 + 40 / n if n share it; what is named together with a hit in
    another request gets 30 % of its score (one hop).  Scores below 10 are no candidates; ties go by number.
    """
    t = records(spark, sf_dir, "prompt", "instruction", "input_ifc", "split").select("rec_id", labels.split(F.col("split")).alias("split"), labels.model_key(F.col("input_ifc")).alias("model"), F.coalesce("prompt", "instruction").alias("text")).where("model is not null and text is not null")
    named = t.select("rec_id", "split", "model", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("'([^':]+:[0-9]{8})'"), F.lit(1)))).alias("label"))
    named = named.select("rec_id", "split", "model", F.split_part("label", F.lit(":"), F.lit(1)).alias("name"), F.split_part("label", F.lit(":"), F.lit(2)).alias("number"))
    index = named.select("model", "name", "number").distinct().withColumn("n", F.count("*").over(Window.partitionBy("model", "name")))
    asked = t.where("split <> 'train'")
    numbers = asked.select("rec_id", "model", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]{8}"), F.lit(0)))).alias("number")).join(index, ["model", "number"]).select("rec_id", "model", "number", F.lit(60).alias("s"))
    quoted = asked.select("rec_id", "model", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("'([^':]+)[:']"), F.lit(1)))).alias("name")).join(index, ["model", "name"])
    names = quoted.select("rec_id", "model", "number", F.when(F.col("n") == 1, 80).otherwise(40 + F.floor(F.lit(40) / F.col("n"))).cast("int").alias("s"))
    hits = numbers.unionByName(names).groupBy("rec_id", "model", "number").agg(F.sum("s").alias("s"))
    together = named.select("rec_id", "model", "number").toDF("other", "model", "number").join(named.select("rec_id", "model", F.col("number").alias("also")).withColumnRenamed("rec_id", "other"), ["other", "model"]).where("number <> also").select("model", "number", "also").distinct()
    spread = hits.join(together, ["model", "number"]).groupBy("rec_id", "model", F.col("also").alias("number")).agg(F.max(F.floor(F.col("s") * 3 / 10)).alias("s"))
    total = hits.unionByName(spread).groupBy("rec_id", "number").agg(F.sum("s").cast("long").alias("score")).where("score >= 10")
    return total.withColumn("place", F.row_number().over(Window.partitionBy("rec_id").orderBy(F.desc("score"), "number"))).where("place <= 20")


def r12_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of each request as one line, while it stays under 60 characters."""
    by = Window.partitionBy("rec_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = r_candidates(spark, sf_dir).withColumn("used", F.sum(F.length("number") + 2).over(by)).where("used < 60")
    return rows.groupBy("rec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "number"))), lambda s: s["number"]), ", ").alias("line"))


def _resolver(condition: str, more: str = "") -> str:
    return f"WITH {ANCHORS}{more} SELECT ref, id FROM n WHERE {condition}"


_R = f"""{RECORDS}, u AS (SELECT rec_id, {SPLIT} AS split, {MODEL} AS model, coalesce(prompt, instruction) AS text FROM t WHERE {MODEL} IS NOT NULL AND coalesce(prompt, instruction) IS NOT NULL),
nm AS (SELECT rec_id, split, model, split_part(l, ':', 1) AS name, split_part(l, ':', 2) AS number FROM (SELECT *, unnest(list_distinct(regexp_extract_all(text, '''([^'':]+:[0-9]{{8}})''', 1))) AS l FROM u)),
ix AS (SELECT model, name, number, count(*) OVER (PARTITION BY model, name) AS n FROM (SELECT DISTINCT model, name, number FROM nm)), ak AS (SELECT * FROM u WHERE split <> 'train'),
h1 AS (SELECT rec_id, model, number, 60 AS s FROM (SELECT rec_id, model, unnest(list_distinct(regexp_extract_all(text, '[0-9]{{8}}'))) AS number FROM ak) JOIN ix USING (model, number)),
h2 AS (SELECT rec_id, model, number, CASE WHEN n = 1 THEN 80 ELSE 40 + 40 // n END AS s FROM (SELECT rec_id, model, unnest(list_distinct(regexp_extract_all(text, '''([^'':]+)['':]', 1))) AS name FROM ak) JOIN ix USING (model, name)),
hh AS (SELECT rec_id, model, number, sum(s) AS s FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL), tg AS (SELECT DISTINCT a.model, a.number, b.number AS also FROM nm a JOIN nm b USING (rec_id, model) WHERE a.number <> b.number),
sp AS (SELECT rec_id, model, also AS number, max(s * 3 // 10) AS s FROM hh JOIN tg USING (model, number) GROUP BY ALL), tt AS (SELECT rec_id, number, sum(s)::BIGINT AS score FROM (SELECT * FROM hh UNION ALL SELECT * FROM sp) GROUP BY ALL HAVING sum(s) >= 10),
rk AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY score DESC, number)::INT AS place FROM tt QUALIFY place <= 20)"""
_D2 = "(x - ax) * (x - ax) + (y - ay) * (y - ay)"

QUERIES = {
    "ref_g2_delta_prf": g2_delta_prf, "ref_g4_remap": g4_remap, "ref_g6_ancestors": g6_ancestors, "ref_g7_dangling": g7_dangling, "ref_g10_bounds": g10_bounds, "ref_g17_crossings": g17_crossings, "ref_g22_in_line": g22_in_line, "ref_g23_free_slots": g23_free_slots,
    "ref_g24_within": g24_within, "ref_g25_unique_labels": g25_unique_labels, "ref_g26_inventory": g26_inventory,
    "ref_j13_mutual_nearest": j13_greedy, "ref_j15_box_overlap": j15_box_overlap, "ref_j16_points_in_boxes": j16_points_in_boxes, "ref_j17_knn": j17_knn, "ref_j18_two_hops": j18_two_hops,
    "ref_r7_geometry": r7_geometry, "ref_r_candidates": r_candidates, "ref_r12_list": r12_list,
    "ref_resolve_above": resolve_above, "ref_resolve_beside": resolve_beside, "ref_resolve_between": resolve_between, "ref_resolve_bounding": resolve_bounding, "ref_resolve_extreme": resolve_extreme, "ref_resolve_nearest": resolve_nearest,
    "ref_resolve_negation": resolve_negation, "ref_resolve_offset": resolve_offset, "ref_resolve_opposite": resolve_opposite, "ref_resolve_ordinal": resolve_ordinal, "ref_resolve_set": resolve_set,
}
SQL = {
    "ref_g2_delta_prf": """WITH e AS (SELECT s_nationkey AS nation, l_partkey, l_suppkey, max((l_returnflag = 'A')::INT) AS a, max((l_returnflag = 'R')::INT) AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), s AS (SELECT nation, sum(a * b)::BIGINT AS hit, sum(a)::BIGINT AS na, sum(b)::BIGINT AS nb FROM e GROUP BY nation)
    SELECT nation, hit, na - hit AS added, nb - hit AS removed, CASE WHEN na = 0 AND nb = 0 THEN 1.0 WHEN na = 0 OR nb = 0 THEN 0.0 ELSE hit::DOUBLE / na END AS precision, CASE WHEN na = 0 AND nb = 0 THEN 1.0 WHEN na = 0 OR nb = 0 THEN 0.0 ELSE hit::DOUBLE / nb END AS recall, CASE WHEN na = 0 AND nb = 0 THEN 1.0 WHEN na = 0 OR nb = 0 OR hit = 0 THEN 0.0 ELSE (2 * hit)::DOUBLE / (na + nb) END AS f1 FROM s""",
    "ref_g4_remap": f"WITH {EDGES}, m AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS new FROM part), x AS (SELECT DISTINCT coalesce(new, src) AS src, dst FROM ed LEFT JOIN m ON src = p_partkey) SELECT dst, count(*) AS n FROM x GROUP BY dst",
    "ref_g6_ancestors": "WITH RECURSIVE a AS (SELECT p_partkey AS id, p_partkey AS up, 0 AS depth FROM part UNION ALL SELECT id, up // 3, depth + 1 FROM a WHERE up // 3 > 0 AND depth < 8) SELECT depth, count(*) AS n, count(DISTINCT up) AS ancestors FROM a WHERE depth > 0 GROUP BY depth",
    "ref_g7_dangling": """SELECT 'result' AS kind, count(*) AS n FROM task_result WHERE task_id IS NOT NULL AND task_id NOT IN (SELECT task_id FROM task WHERE task_id IS NOT NULL) UNION ALL SELECT 'request', count(*) FROM request_props WHERE base_task_id IS NOT NULL AND base_task_id NOT IN (SELECT task_id FROM task WHERE task_id IS NOT NULL) UNION ALL SELECT 'outcome', count(*) FROM outcome WHERE run_id IS NOT NULL AND run_id NOT IN (SELECT run_id FROM funnel)""",
    "ref_g10_bounds": f"WITH {ELEMENTS} SELECT storey, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM el GROUP BY storey",
    "ref_g17_crossings": f"""WITH {BOXES}, p AS (SELECT a.id AS a, b.id AS b, a.x0 AS ax, a.y0 AS ay, a.x1 AS bx, a.y1 AS by_, b.x0 AS cx, b.y1 AS cy, b.x1 AS dx, b.y0 AS dy FROM bx a JOIN bx b ON a.id < b.id)
    SELECT a, b FROM p WHERE sign((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) * sign((bx - ax) * (dy - ay) - (by_ - ay) * (dx - ax)) < 0 AND sign((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) * sign((dx - cx) * (by_ - cy) - (dy - cy) * (bx - cx)) < 0""",
    "ref_g22_in_line": f"WITH {ELEMENTS} SELECT a.storey, a.id AS a, b.id AS b FROM el a JOIN el b ON a.storey = b.storey AND a.id < b.id AND abs(a.y - b.y) <= 3 AND abs(a.x - b.x) <= 300",
    "ref_g23_free_slots": f"WITH {BOXES}, w AS (SELECT storey, max(x1) OVER (PARTITION BY storey ORDER BY x0, id ROWS UNBOUNDED PRECEDING) AS from_x, lead(x0) OVER (PARTITION BY storey ORDER BY x0, id) AS to_x FROM bx JOIN el USING (id)) SELECT * FROM w WHERE to_x - from_x >= 30",
    "ref_g24_within": f"WITH {ELEMENTS} SELECT a.id AS a, b.id AS b FROM el a JOIN el b ON a.id < b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 3600",
    "ref_g25_unique_labels": "SELECT p_brand, count(*) AS unique_names FROM (SELECT p_brand, p_name FROM part GROUP BY ALL HAVING count(*) = 1) GROUP BY p_brand",
    "ref_g26_inventory": "SELECT p_brand, count(DISTINCT p_type) AS types, count(DISTINCT p_size) AS sizes, min(p_size) AS least, max(p_size) AS most FROM part GROUP BY p_brand",
    "ref_j13_mutual_nearest": f"WITH {ELEMENTS}, k AS (SELECT a.id AS ref, b.id FROM el a JOIN el b ON a.storey = b.storey AND a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), b.id) = 1) SELECT k.ref, k.id FROM k JOIN k m ON k.ref = m.id AND k.id = m.ref WHERE k.ref < k.id",
    "ref_j15_box_overlap": f"WITH {BOXES} SELECT a.id AS a, b.id AS b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS area FROM bx a JOIN bx b ON a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1",
    "ref_j16_points_in_boxes": f"WITH {BOXES} SELECT bx.id AS a, count(*) AS n FROM bx JOIN el ON el.x BETWEEN x0 AND x1 AND el.y BETWEEN y0 AND y1 GROUP BY bx.id",
    "ref_j17_knn": f"WITH {ANCHORS} SELECT ref, id, row_number() OVER (PARTITION BY ref ORDER BY {_D2} + (z - az) * (z - az), id)::INT AS place FROM n QUALIFY place <= 5",
    "ref_j18_two_hops": f"""WITH {EDGES}, o AS (SELECT DISTINCT b.src AS part FROM ed a JOIN ed b USING (dst) WHERE a.src = 1 AND b.src <> 1), w AS (SELECT DISTINCT c.src AS part FROM o JOIN ed b ON b.src = o.part JOIN ed c USING (dst)), s AS (SELECT part, 30 AS s FROM o UNION ALL SELECT part, 18 FROM w), m AS (SELECT part, max(s) AS score FROM s WHERE part <> 1 GROUP BY part) SELECT score, count(*) AS n FROM m GROUP BY score""",
    "ref_r7_geometry": f"""WITH {ANCHORS}, k AS (SELECT ref, id, row_number() OVER (PARTITION BY ref ORDER BY {_D2} + (z - az) * (z - az), id) AS place FROM n), s AS (SELECT ref, id, 12 - 2 * place AS s FROM k WHERE place <= 5 UNION ALL SELECT ref, id, 6 FROM n WHERE {_D2} <= 40000 AND z - az > 150
    UNION ALL SELECT ref, id, 5 FROM n WHERE abs(x - ax - 150) <= 120 AND abs(y - ay) <= 120 UNION ALL SELECT ref, id, 8 FROM n WHERE x > ax AND abs(y - ay) <= x - ax), t AS (SELECT ref, id, sum(s)::BIGINT AS score FROM s GROUP BY ALL HAVING sum(s) >= 10)
    SELECT *, row_number() OVER (PARTITION BY ref ORDER BY score DESC, id)::INT AS place FROM t QUALIFY place <= 10""",
    "ref_r_candidates": f"WITH {_R} SELECT rec_id, number, score, place FROM rk",
    "ref_r12_list": f"WITH {_R}, us AS (SELECT *, sum(length(number) + 2) OVER (PARTITION BY rec_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS used FROM rk) SELECT rec_id, string_agg(number, ', ' ORDER BY place) AS line FROM us WHERE used < 60 GROUP BY rec_id",
    "ref_resolve_above": _resolver(f"{_D2} <= 40000 AND z - az > 150"),
    "ref_resolve_beside": f"WITH {ANCHORS} SELECT ref, count(*) AS n FROM n WHERE (ax - ay) * (y - ay) - az * (x - ax) >= 20000 GROUP BY ref",
    "ref_resolve_between": f"""WITH {ANCHORS}, p AS (SELECT a.ref, a.storey, a.ax, a.ay, b.ax AS bx, b.ay AS by_, row_number() OVER (PARTITION BY a.ref ORDER BY b.ref) AS k FROM an a JOIN an b ON a.storey = b.storey AND a.ref < b.ref), i AS (SELECT *, (greatest(ax, bx) - least(ax, bx)) // 20 AS inset FROM p WHERE k = 1)
    SELECT ref, id FROM i JOIN el USING (storey) WHERE id <> ref AND x > least(ax, bx) + inset AND x < greatest(ax, bx) - inset AND abs(2 * y - ay - by_) <= 200""",
    "ref_resolve_bounding": f"WITH {EDGES} SELECT a.dst AS ref, count(*) AS n, min(a.src) AS least FROM ed a JOIN ed b ON a.src = b.src AND b.dst = a.dst + 1 GROUP BY a.dst",
    "ref_resolve_extreme": f"WITH {ELEMENTS}, m AS (SELECT storey AS ref, id, x, max(x) OVER (PARTITION BY storey) AS t FROM el WHERE storey IS NOT NULL) " + _ONE.format("SELECT ref, id FROM m WHERE x >= t - 20"),
    "ref_resolve_nearest": f"WITH {ANCHORS}, m AS (SELECT ref, id, {_D2} AS d, min({_D2}) OVER (PARTITION BY ref) AS t FROM n) " + _ONE.format("SELECT ref, id FROM m WHERE d <= t + 100"),
    "ref_resolve_negation": "SELECT p_brand AS ref, count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 48) GROUP BY p_brand",
    "ref_resolve_offset": _resolver("abs(x - ax - 150) <= 120 AND abs(y - ay) <= 120"),
    "ref_resolve_opposite": f"WITH {ANCHORS}, c AS (SELECT storey, min(x) + max(x) AS sx, min(y) + max(y) AS sy FROM el GROUP BY storey), m AS (SELECT ref, id, (x - sx + ax) * (x - sx + ax) + (y - sy + ay) * (y - sy + ay) AS d FROM n JOIN c USING (storey)) " + _ONE.format("SELECT ref, id FROM m QUALIFY d = min(d) OVER (PARTITION BY ref)"),
    "ref_resolve_ordinal": f"WITH {ELEMENTS}, o AS (SELECT storey, id, row_number() OVER w AS n, x - lag(x) OVER w AS a, lead(x) OVER w - x AS b FROM el WHERE storey IS NOT NULL WINDOW w AS (PARTITION BY storey ORDER BY x, id)) SELECT storey AS ref, id FROM o WHERE n = 3 AND coalesce(a, 5) >= 5 AND coalesce(b, 5) >= 5",
    "ref_resolve_set": f"WITH {ELEMENTS} SELECT storey AS ref, id FROM el WHERE z > 100",
}
