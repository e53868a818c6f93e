import itertools
import math
import random
import time
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwork.functions import kernels as k
from spanwork.functions import stats
from spanwork.plans.results import x8_holm


def column(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(expression).first()[0]


def test_intervals_against_frozen_numbers(spark):
    low, high = stats.wilson(F.col("k"), F.col("n"), 1.959964)
    assert column(spark, low, k=52, n=732) == pytest.approx(0.05458205649406944, abs=1e-12)
    assert column(spark, high, k=52, n=732) == pytest.approx(0.09197323415950148, abs=1e-12)
    p = stats.mcnemar_exact(F.col("b"), F.col("c"))
    assert [column(spark, p, b=b, c=c) for b, c in ((1, 2), (4, 7), (17, 14), (0, 0))] == pytest.approx([1.0, 0.548828125, 0.720100131817162, 1.0])
    p = stats.fisher_exact(*map(F.col, "abcd"))
    assert column(spark, p, a=3, b=1, c=1, d=3) == pytest.approx(0.4857142857)
    assert column(spark, p, a=8, b=2, c=1, d=5) == pytest.approx(0.0349650350, abs=1e-8)


def test_fisher_of_many_cases(spark):
    p = stats.fisher_exact(*map(F.col, "abcd"))

    def exact(a, b, c, d):
        row, whole, n = a + b, a + c, a + b + c + d
        ways = [math.comb(row, x) * math.comb(n - row, whole - x) for x in range(max(0, whole - (n - row)), min(row, whole) + 1)]
        own = math.comb(row, a) * math.comb(n - row, c)
        return float(Fraction(sum(w for w in ways if w <= own), math.comb(n, whole)))

    for t in ((400, 390, 380, 420), (300, 10, 500, 900), (20, 3000, 4, 3000), (0, 9, 5, 0)):
        assert column(spark, p, **dict(zip("abcd", t))) == pytest.approx(exact(*t), rel=1e-10)
    assert column(spark, p, a=0, b=0, c=0, d=0) == 1.0 and column(spark, p, a=100_000, b=0, c=0, d=100_000) == 0.0
    begin = time.perf_counter()
    assert column(spark, p, a=60_000, b=60_000, c=60_400, d=59_600) == pytest.approx(0.103, abs=1e-3)
    assert time.perf_counter() - begin < 20  # tables and sums over them are not multiplied


def test_mcnemar_of_many_cases(spark):
    p = stats.mcnemar_exact(F.col("b"), F.col("c"))
    for b, c in ((100, 140), (1100, 990), (2101, 2000), (500, 1500), (0, 40)):
        want = 2 * float(Fraction(sum(math.comb(b + c, k) for k in range(min(b, c) + 1)), 2 ** (b + c)))
        assert column(spark, p, b=b, c=c) == pytest.approx(want, rel=1e-10)
    assert column(spark, p, b=3, c=3) == 1.0 and column(spark, p, b=10, c=100_000) == 0.0
    begin = time.perf_counter()
    assert column(spark, p, b=60_000, c=60_500) == pytest.approx(0.1504, abs=1e-3)
    assert time.perf_counter() - begin < 20


def test_holm_of_many_cases(spark, tmp_path):
    """Two adapters on 160,000 tasks; the tests of three pairs are one family."""
    score = "named_struct('geometry', {0}, 'semantics', {0}, 'topology', {0})"
    done = {"a": "id % 2 = 0", "b": "id % 2 = 1 or id < 800", "c": "id % 4 = 0"}
    rows = [f"select '{k}' as adapter, cast(id as string) as task_id, timestamp'2025-01-01' as run_at, 1L as input_tokens, {score.format(f'if({v}, 1.0D, 0.0D)')} as score from range(160000)" for k, v in done.items()]
    spark.sql(" union all ".join(rows)).write.parquet(f"{tmp_path}/task_result.parquet")
    begin = time.perf_counter()
    got = {r.a + r.b: (r.p, r.p_adjusted) for r in x8_holm(spark, str(tmp_path)).collect()}
    assert time.perf_counter() - begin < 40
    p = 2 * 0.5 * math.erfc((400 - 1) / math.sqrt(159_600) / math.sqrt(2))
    assert got["ab"] == (pytest.approx(p, rel=1e-3), pytest.approx(p, rel=1e-3)) and got["ac"] == got["bc"] == (0.0, 0.0)


def test_holm_reads_verdicts_only(spark, tmp_path):
    """The latest run of a task counts; columns that say nothing about it are not read, let alone sent."""
    good, poor = ("named_struct('geometry', {0}, 'semantics', 1.0D, 'topology', 1.0D)".format(v) for v in ("1.0D", "0.5D"))
    run = "select '{}' as adapter, {} as task_id, {} as run_at, {} as input_tokens, {} as score, repeat('x', 1000) as reply from range({})".format
    day, day_before = "timestamp_ntz'2025-01-02'", "timestamp_ntz'2025-01-01'"
    rows = [
        run("a", "string(id)", day, "5L", good, 40),
        run("b", "string(id)", day, "5L", f"if(id < 10, {poor}, {good})", 40),
        run("b", "string(id)", day_before, "9L", f"if(id < 10, {good}, {poor})", 40),  # earlier runs, the other way round
        run("b", "string(id)", day, "4L", poor, "20, 40"),  # as late, with fewer tokens or none
        run("b", "string(id)", day, "cast(null as long)", poor, "20, 40"),
        run("a", "string(id)", "cast(null as timestamp_ntz)", "9L", poor, 40),
        run("c", "string(id)", day, "5L", "null", 40),  # without a score: not done
        run("b", "cast(null as string)", day, "5L", poor, 1000),
    ]
    spark.sql(" union all ".join(rows)).write.parquet(f"{tmp_path}/task_result.parquet")
    holm = x8_holm(spark, str(tmp_path))
    assert "reply#" not in holm._jdf.queryExecution().executedPlan().toString()
    got = {r.a + r.b: (r.p, r.p_adjusted) for r in holm.collect()}
    want = {"ab": (2 * 0.5**10, 2 * 0.5**10), "ac": (2 * 0.5**40, 6 * 0.5**40), "bc": (2 * 0.5**30, 4 * 0.5**30)}
    assert got == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()}


def likelihood_score(b, c, n, delta):
    """The same statistic from a search for the most likely share under the hypothesis."""
    low, high = max(0.0, -delta) + 1e-12, (1 - delta) / 2 - 1e-12
    log_l = lambda q: b * math.log(q + delta) + c * math.log(q) + (n - b - c) * math.log(max(1e-300, 1 - 2 * q - delta))
    for _ in range(200):
        x, y = low + (high - low) / 3, high - (high - low) / 3
        low, high = (x, high) if log_l(x) < log_l(y) else (low, y)
    return (b - c - n * delta) / math.sqrt(n * (2 * low + delta - delta * delta))


def test_score_interval():
    for b, c, n, delta in ((9, 3, 40, 0.1), (3, 9, 40, 0.1), (9, 3, 40, -0.2), (5, 5, 400, 0.05), (1, 30, 60, -0.4)):
        assert k.paired_score(b, c, n, delta) == pytest.approx(likelihood_score(b, c, n, delta), abs=1e-5)
    b, c, n = np.array([9, 0, 10, 0]), np.array([3, 0, 0, 10]), np.array([40, 10, 10, 10])
    low, high = k.paired_score_interval(b, c, n)
    assert k.paired_score(9, 3, 40, low[0]) == pytest.approx(1.959964, abs=1e-5) and k.paired_score(9, 3, 40, high[0]) == pytest.approx(-1.959964, abs=1e-5)
    assert low[1] == pytest.approx(-high[1]) and -1 < low[1] < 0 and high[2] == pytest.approx(1) and low[3] == pytest.approx(-1)
    assert k.equivalence_p(5, 5, 400, 0.05) < 0.05 < k.equivalence_p(5, 5, 20, 0.05)


def test_holm_and_newcombe(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)], "t string, p double")
    rows = df.withColumn("s", stats.holm(F.col("p"), "t")).withColumn("h", stats.running_max(F.col("s"), "p", "t"))
    assert {r.t: round(r.h, 10) for r in rows.collect()} == {"d": 0.02, "a": 0.03, "c": 0.06, "b": 0.06}
    low, high = stats.newcombe_independent(F.col("a"), F.col("m"), F.col("b"), F.col("n"))
    assert column(spark, low, a=56, m=70, b=48, n=80) == pytest.approx(0.0524, abs=1e-4)
    assert column(spark, high, a=56, m=70, b=48, n=80) == pytest.approx(0.3339, abs=1e-4)
    low, high = stats.newcombe_paired(*map(F.col, "abcd"))
    assert column(spark, low, a=10, b=5, c=1, d=4) < 0.2 < column(spark, high, a=10, b=5, c=1, d=4)


def test_bootstraps():
    mean, low, high = k.histogram_bootstrap([0, 1], [50, 50])
    assert mean == 0.5 and 0.38 < low < 0.42 and 0.58 < high < 0.62
    assert k.histogram_bootstrap([1, 0], [30, 70])[0] == pytest.approx(0.3) and math.isnan(k.histogram_bootstrap([], [])[0])
    w = k.cluster_weights(5, 4000)
    assert (w == k.cluster_weights(5, 4000)).all() and abs(w.mean() - 1) < 0.1 and abs(w.var() - 1) < 0.15


def test_student_and_correlation():
    assert k.student_quantile(0.975, 4) == pytest.approx(2.776445, abs=1e-5) and k.student_quantile(0.025, 4) == pytest.approx(-2.776445, abs=1e-5)
    mean, low, high = k.t_interval([1, 2, 3, 4, 5])
    assert (mean, round(low, 4), round(high, 4)) == (3.0, 1.0368, 4.9632)
    assert k.pearson([1, 2], [1, 2]) is None and k.pearson([1, 1, 1], [1, 2, 3]) is None and k.pearson([1, 2, 3], [2, 4, 6]) == pytest.approx(1)


def test_gee_equals_a_two_by_two_table_without_clusters():
    x = np.array([0] * 50 + [1] * 50)
    y = np.array([1] * 10 + [0] * 40 + [1] * 30 + [0] * 20)
    beta, error = k.gee_logit(y, np.column_stack([np.ones(100), x]), np.arange(100))
    assert beta[1] == pytest.approx(math.log(30 / 20) - math.log(10 / 40), abs=1e-6)
    assert error[1] == pytest.approx(math.sqrt(1 / 10 + 1 / 40 + 1 / 30 + 1 / 20), rel=0.03)


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 5), (5, 3), (6, 6)):
        c = rng.random((n, m))
        got = k.assignment(c)
        small = min(n, m)
        best = min(sum(c[i, j] for i, j in zip(rows, cols)) for rows in itertools.combinations(range(n), small) for cols in itertools.permutations(range(m), small))
        assert len(got) == small and sum(c[i, j] for i, j in got) == pytest.approx(best)
    assert k.assignment(np.zeros((0, 3))) == []


def test_boxes_clouds_and_hulls():
    box = (np.zeros(3), np.ones(3), np.eye(3))
    assert k.box_iou(box, box) == pytest.approx(1) and k.box_iou(box, (np.array([5.0, 0, 0]), np.ones(3), np.eye(3))) == 0
    assert k.box_iou(box, (np.zeros(3), np.array([1, 1, 0.5]), np.eye(3))) == pytest.approx(0.5)
    rng = np.random.default_rng(2)
    centre, half, axes = k.oriented_box(rng.uniform(-1, 1, (4000, 3)) * [4, 2, 1] + [10, 0, 0])
    assert sorted(half) == pytest.approx([1, 2, 4], abs=0.3) and centre == pytest.approx([10, 0, 0], abs=0.3)
    square = np.array([[0, 0, 0], [2, 0, 0], [2, 2, 0], [0, 2, 0]], float)
    points = k.surface_sample(square, np.array([[0, 1, 2], [0, 2, 3]]), 500, 3)
    assert points.min() >= 0 and points.max() <= 2 and np.abs(points[:, :2].mean(axis=0) - 1).max() < 0.1
    assert k.chamfer(points, points) == 0 and k.chamfer(square, square + [0, 0, 3], "mean") == pytest.approx(3)
    assert len(k.convex_hull(np.vstack([square, [[1, 1, 0], [1, 0, 0]]]))) == 4 and k.hull_span(square, [1, 0]) == (0, 2)


def test_allocation():
    assert k.water_fill([1, 10, 10], 9) == [1, 4, 4] and sum(k.water_fill([1, 1], 9)) == 2
    assert k.capped_quota([50, 30, 20], [100, 100, 100], 10) == [5, 3, 2]
    assert k.capped_quota([50, 30, 20], [2, 100, 100], 10) == [2, 5, 3] and sum(k.capped_quota([1, 1], [1, 1], 9)) == 2
    rng = random.Random(0)
    load = k.least_loaded([rng.random() for _ in range(100)], 7)
    assert set(load) == set(range(7))
    assert k.greedy_cover([{"a"}, {"a", "b"}, {"c"}], {"a": 1, "b": 1, "c": 1}) == [1, 2]
    assert k.greedy_match([(0.9, 1, 1), (0.8, 1, 2), (0.7, 2, 1), (0.1, 2, 2)]) == [(1, 1), (2, 2)]
