import itertools
import random

import pytest
from pyspark.sql import functions as F

from spanwork.functions import messages, rewards, text
from spanwork.operators import references, selection, sets, spatial
from spanwork.operators.similarity import jaccard_pairs
from spanwork.plans.texts import g5_duplicate_groups


def test_similarity_join_equals_brute_force(spark):
    rng = random.Random(1)
    base = [[f"w{rng.randint(0, 40)}" for _ in range(rng.randint(1, 15))] for _ in range(60)]
    rows = [(i, list(dict.fromkeys(w))) for i, w in enumerate(base + [b[:-1] + ["x"] for b in base] + [["hot"]] * 3)]
    df = spark.createDataFrame([*rows, (900, []), (901, None)], "id long, s array<string>")
    for t in (0.5, 0.8, 1.0):
        got = {(r.a, r.b) for r in jaccard_pairs(df, "id", "s", t).collect()}
        want = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if len(set(x) & set(y)) >= t * len(set(x) | set(y)) - 1e-9}
        assert got == want
    assert jaccard_pairs(df.limit(0), "id", "s").count() == 0


def _shuffled(spark):
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_similarity_join_of_all_sizes_and_of_copies(spark):
    rng = random.Random(5)
    base = [(i, rng.sample(range(10**6), n)) for i, n in enumerate([1, 4, 5, 9, 150, 190, 200, 390, 900, 1700] * 2)]
    near = [(100 + i, m[: -max(1, len(m) // 12)] + rng.sample(range(10**6, 2 * 10**6), len(m) // 12)) for i, m in base]
    more = [(200 + i, m + rng.sample(range(2 * 10**6, 3 * 10**6), len(m) // 4)) for i, m in base]
    rows = [(i, m) for i, m in base + near + more if m]
    df = spark.createDataFrame([*((i, m, i) for i, m in rows), *((i + 1000, m[::-1], i) for i, m in rows)], "id long, s array<long>, copy long").repartition(3)
    for t in (0.3, 0.8, 0.9):
        want = {(a, b, len(set(x) & set(y))) for (a, x), (b, y) in itertools.combinations(rows, 2) if len(set(x) & set(y)) >= t * len(set(x) | set(y)) - 1e-9}
        assert {(r.a, r.b, r.common) for r in jaccard_pairs(df, "id", "s", t, copy="copy").collect()} == want and want


def test_similarity_join_writes_neither_members_nor_chance_meetings(spark):
    """3,000 sets of 100 members; the rarest of each stand in 40 others, too, which have nothing else in common with it."""
    rng = random.Random(6)
    rows = [(i, [f"r{rng.randint(0, 1500)}" for _ in range(20)] + [f"c{rng.randint(0, 700)}" for _ in range(110)]) for i in range(3000)]
    df = spark.createDataFrame([(i, sorted(set(m))) for i, m in rows], "id long, s array<string>")
    before = _shuffled(spark)
    assert jaccard_pairs(df, "id", "s").count() == 0
    assert _shuffled(spark) - before < 5_000_000


def test_duplicate_groups_write_little(spark, tmp_path):
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(200)) for _ in range(1500)]
    texts[10:13] = [texts[0].upper(), texts[0] + " end", texts[0] + " end of it"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5000, None), (5001, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = _shuffled(spark)
    got = {r.doc_id: (r.group_id, r.n) for r in g5_duplicate_groups(spark, str(tmp_path)).collect()}
    assert got == {i: (0, 4) if i in (0, 10, 11, 12) else (i, 1) for i, t in rows if t is not None}
    assert _shuffled(spark) - before < 5_000_000


def test_quotas_and_round_robin(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2), (None, 1)], "s string, n long")
    quota = {r.s: r.quota for r in selection.largest_remainder(counts, "n", 7, "s").collect()}
    assert sum(quota.values()) == 7 and quota["a"] == 3
    rows = spark.createDataFrame([(i, "ab"[i > 7]) for i in range(10)], "id long, cell string")
    taken = selection.round_robin(rows, ["cell"], "id", 5).collect()
    assert sorted(r.depth for r in taken) == [1, 1, 2, 2, 3]
    assert selection.round_robin(rows.limit(0), ["cell"], "id", 5).count() == 0


def test_quota_and_global_rank_equal_plain_windows(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else "cold", None if i % 7 else "x") for i in range(3000)], "id long, cell string, note string")
    quota = spark.createDataFrame([("hot", 700), ("cold", 5), ("none", 4), (None, 9)], "cell string, quota long")
    got = {(r.id, r.depth) for r in selection.take_quota(rows, quota, ["cell"], "id").collect()}
    plain = rows.join(quota, "cell").withColumn("depth", selection.depth(["cell"], selection.hash_order(7, "id"), "id")).where("depth <= quota")
    assert got == {(r.id, r.depth) for r in plain.collect()} and len(got) == 705
    ranked = selection.global_rank(spark, rows.repartition(5), "n", F.desc("cell"), "id").collect()
    want = sorted(((r.id, r.cell) for r in rows.collect()), key=lambda r: (r[1] == "cold", r[0]))
    assert {r.id: r.n for r in ranked} == {i: n for n, (i, _) in enumerate(want, 1)}
    assert selection.global_rank(spark, rows.limit(0), "n", "id").count() == 0


def test_islands_and_repair(spark):
    rows = spark.createDataFrame([(1, i, k) for i, k in enumerate(["x", "x", None, None, "x", "y"])], "u long, t long, k string")
    got = [r.island for r in selection.islands(rows, ["u"], ["t"], F.col("k")).orderBy("t").collect()]
    assert got == [1, 1, 2, 2, 3, 4]
    pool = spark.createDataFrame([(i, "s") for i in range(6)], "id long, s string")
    fixed = selection.repair(pool.where("id < 3"), pool, pool.where("id = 1"), "s", "id").collect()
    assert len(fixed) == 3 and 1 not in {r.id for r in fixed} and sum(r.replaces == 1 for r in fixed) == 1


def test_differences(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "k long, v string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", 2), (4, "w", 1)], "k long, v string, n int")
    got = {(r.k, r.status, tuple(r.changed)) for r in sets.keyed_diff(a, b, ["k"], ["v", "n"]).collect()}
    assert got == {(2, "modified", ("n",)), (3, "deleted", ()), (4, "created", ())}
    m = spark.createDataFrame([("p",), ("p",), (None,)], "v string")
    assert {(r.v, r.surplus) for r in sets.multiset_except(m, m.limit(0).union(spark.createDataFrame([("p",)], "v string"))).collect()} == {("p", 1), (None, 1)}
    assert {(r.k, r.n) for r in sets.upsert(a, b, ["k"]).select("k", "n").collect()} == {(1, None), (2, 2), (3, 1), (4, 1)}
    sizes = spark.createDataFrame([(0, 0, 0), (0, 0, 3), (1, 2, 1), (0, 2, 2)], "h int, c int, r int")
    p, r, f1 = sets.precision_recall(F.col("h"), F.col("c"), F.col("r"))
    assert [tuple(x) for x in sizes.select(p, r, f1).collect()] == [(1, 1, 1), (0, 0, 0), (0.5, 1.0, 2 / 3), (0.0, 0.0, 0.0)]
    overlap = sets.overlap(spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 9)], "s string, m int"), "s", "m").collect()
    assert [(r.a, r.b, r.common, r.size_a, r.size_b) for r in overlap] == [("a", "b", 1, 2, 1)]


def test_boxes_and_distances_equal_brute_force(spark):
    rng = random.Random(3)
    boxes = [(i, x, x + rng.randint(0, 90), y, y + rng.randint(0, 90)) for i in range(120) for x, y in [(rng.randint(-300, 300), rng.randint(-300, 300))]]
    df = spark.createDataFrame(boxes, "id long, x0 long, x1 long, y0 long, y1 long")
    got = sorted((r.a, r.b) for r in spatial.overlap_join(df, df, 40).collect())
    want = sorted((a[0], b[0]) for a in boxes for b in boxes if a[1] <= b[2] and b[1] <= a[2] and a[3] <= b[4] and b[3] <= a[4])
    assert got == want
    points = spark.createDataFrame([(b[0], b[1], b[3]) for b in boxes], "id long, x long, y long")
    got = sorted((r.a, r.b) for r in spatial.within_distance(points, 50).collect())
    assert got == sorted((a[0], b[0]) for a, b in itertools.combinations(boxes, 2) if (a[1] - b[1]) ** 2 + (a[3] - b[3]) ** 2 <= 2500)


def test_references_hold_only_if_unique(spark):
    e = spark.createDataFrame([(1, "s", 0, 0, 0), (2, "s", 10, 0, 0), (3, "s", 10, 0, 5), (4, "t", 0, 0, None)], "id long, storey string, x long, y long, z long")
    r = spark.createDataFrame([(1, "s", 0, 0, 0)], "ref long, storey string, ax long, ay long, az long")
    assert references.unique(references.nearest(r, e, 0)).count() == 0  # two equally near
    assert [(x.ref, x.id) for x in references.unique(references.above(r, e, 20, 1)).collect()] == [(1, 3)]
    assert {x.ref for x in references.larger_than(e, "z", -1).collect()} == {"s"}  # an unknown measure leaves t undecided
    assert references.ordinal(e, "x", 2, 5).count() == 0 and references.ordinal(e, "x", 1, 5).count() == 2


def test_rewards_against_frozen_numbers(spark):
    cases = [(0, 0, 0), (1, 0, 1), (0.5, 0, 0.5), (0.162, 0.162, 0), (1, 0.162, 1), (0, 0.5, -0.2), (0.9, 0.8427, 0.364272), (0.71, 0.42, 0.5), (0.1, 0.42, -0.2), (0.6, 0.42, 0.310345)]
    df = spark.createDataFrame([tuple(map(float, c)) for c in cases], "f double, n double, w double")
    for r in df.select(rewards.normalised(F.col("f"), F.col("n")).alias("r"), "w").collect():
        assert r.r == pytest.approx(r.w, abs=1e-6)
    shaped = spark.createDataFrame([(0.5, 1), (0.0, 1), (0.0, 7), (0.827586, 8)], "r double, e int").select(rewards.less_errors(F.col("r"), F.col("e")))
    assert [x[0] for x in shaped.collect()] == pytest.approx([0.48, -0.02, -0.10, 0.727586])
    gate = spark.createDataFrame([(0.5, True), (0.5, False), (-0.1, None)], "r double, c boolean").select(rewards.commit_gate(F.col("r"), F.col("c")))
    assert [x[0] for x in gate.collect()] == [0.5, 0.0, -0.1]


def test_messages_and_text(spark):
    m = "array<struct<role:string,content:string>>"
    df = spark.createDataFrame([([("system", "a"), ("user", "b"), ("assistant", "c")],), ([("user", "b")],), ([],)], f"m {m}")
    assert [len(r[0]) for r in df.select(messages.prompt_part(F.col("m"))).collect()] == [2, 1, 0]
    assert df.select(messages.loss_mask(F.col("m"))).first()[0] == [False, False, True]
    codes = spark.createDataFrame([(["a", "a", None, None, None, "a"],), ([],)], "c array<string>")
    assert [r[0] for r in codes.select(messages.longest_repeat(F.col("c"))).collect()] == [3, 0]
    one = spark.createDataFrame([('{"code": "x = 1"}', "y  =  2\n\n    z  = 3  \n", "say ‘hi’ to   «all»", "2Jzp$aIqUQEu2IrVK1Ey2c, IfcWall and 2Jzp$aIqUQEu2IrVK1Ey2c")], "j string, c string, q string, g string")
    got = one.select(messages.call_code(F.col("j")), messages.call_code(F.col("c")), messages.tidy_code(F.col("c")), text.tidy(F.col("q")), text.guids(F.col("g")), text.middle_cut(F.col("g"), 11), text.numbers(F.lit("the second of 2.50 m"))).first()
    assert list(got) == ["x = 1", "y  =  2\n\n    z  = 3  \n", "y = 2\n    z = 3", "say 'hi' to \"all\"", ["2Jzp$aIqUQEu2IrVK1Ey2c"], "2Jzp...Ey2c", ["2", "2.50"]]
    words = spark.createDataFrame([("a b c",), ("a",), ("",), (None,)], "t string")
    assert [r[0] for r in words.select(text.ngrams(text.words(F.col("t")), 2)).collect()][:3] == [["a b", "b c"], [], []]
    sets_ = spark.createDataFrame([([], []), (["a"], ["a", "b"])], "a array<string>, b array<string>")
    assert [r[0] for r in sets_.select(text.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.5]
    asks = spark.createDataFrame([("Which wall?", ["which"]), ("Which wall", ["which"]), ("whichever?", ["which"]), (None, ["which"])], "r string, k array<string>")
    assert [r[0] for r in asks.select(text.asks(F.col("r"), F.col("k"))).collect()] == [True, False, False, False]
