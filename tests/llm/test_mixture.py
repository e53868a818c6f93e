import numpy as np
import pytest

from spanwork.llm.mixture import _Mix, match_proportions, quotas, rake

POOL = "pool_table string, rec_key string, operation string, category string, ifc_version string, note string"
TARGETS = "mix_id long, pool_table string, dims string, stratum string, target_permille int, sample_size long, min_rows long, note int"
DIMS = ["operation", "category", "ifc_version"]


def pool(spark, rows):
    return spark.createDataFrame([("task", str(i), o, c, None, "x") for i, (o, c) in enumerate(rows)], POOL)


def run(spark, rows, targets):
    made = spark.createDataFrame([(*t, 7) for t in targets], TARGETS)
    out = match_proportions(spark, pool(spark, rows), made, DIMS)
    return out.sample.collect(), {(r.mix_id, r.stratum): r for r in out.report.collect()}


def test_shares_minimum_and_gap(spark):
    rows = [("create", "direct")] * 500 + [("update", "direct")] * 300 + [("delete", "spatial")] * 4
    targets = [(1, "task", "operation", "create", 500, 100, 0), (1, "task", "operation", "update", 480, 100, 5), (1, "task", "operation", "delete", 20, 100, 10)]
    sample, report = run(spark, rows, targets)
    drawn = {s: r.drawn for (_, s), r in report.items()}
    assert drawn == {"create": 49, "update": 47, "delete": 4}  # the minimum of one is made up by the others: the size stays
    assert report[1, "delete"].gap == 6 and report[1, "create"].gap == 0
    assert len(sample) == 100 and len({(r.mix_id, r.rec_key) for r in sample}) == 100
    assert sum(r.first_draw for r in report.values()) == 100 and sum(r.first_draw for r in sample) >= 90
    assert all(rows[int(r.rec_key)][0] == r.stratum for r in sample)


def test_two_columns_nulls_and_zero_share(spark):
    rows = [("create", "direct")] * 40 + [("create", None)] * 40 + [(None, "direct")] * 40 + [("update", "spatial")] * 10
    targets = [(2, "task", "operation|category", "create|direct", 600, 50, 0), (2, "task", "operation|category", "update|spatial", 0, 50, 3), (2, "task", "operation|category", "delete|direct", 400, 50, 0)]
    sample, report = run(spark, rows, targets)
    drawn = {s: r.drawn for (_, s), r in report.items()}
    assert drawn["delete|direct"] == 0 and drawn["update|spatial"] >= 3 and drawn["create|direct"] >= 30
    assert report[2, "delete|direct"].gap == 20
    assert all(None not in rows[int(r.rec_key)] for r in sample)


def test_raking_changes_the_sample_and_its_margins_meet_the_targets(spark):
    rows = [("create", "direct")] * 20 + [("create", "spatial")] * 400 + [("update", "direct")] * 400 + [("update", "spatial")] * 400
    joint = {"create|direct": 300, "create|spatial": 200, "update|direct": 200, "update|spatial": 300}
    made = spark.createDataFrame([(1, "task", "operation|category", s, p, 200, 0, 1) for s, p in joint.items()], TARGETS)
    out = match_proportions(spark, pool(spark, rows), made, DIMS)
    drawn = {r.stratum: r.drawn for r in out.report.collect()}
    assert drawn["create|direct"] == 20  # wanted 60: 40 short
    assert drawn["create|spatial"] >= 79 and drawn["update|direct"] >= 79 and sum(drawn.values()) == 200  # plain quotas: 40 each
    assert all(abs(r.residual) <= 1 for r in out.margins().collect())
    sample = out.sample.collect()
    assert len(sample) == 200 and 150 <= sum(r.first_draw for r in sample) <= 200


def test_margins_within_a_row_and_minimums_kept():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(2, 5, 2)
        n = rng.integers(0, 90, a * b).astype(float)
        size = float(rng.integers(10, 80))
        share = rng.dirichlet(np.ones(a * b)) * size
        least = np.minimum(n, rng.integers(0, 4, a * b))
        at = [np.repeat(np.arange(a), b), np.tile(np.arange(b), a)]
        margins = [(k, np.bincount(k, share)) for k in at]
        whole = (np.zeros(a * b, int), np.array([max(least.sum(), min(size, n.sum()))]))
        mass = rake(share, [*margins, whole], least, n)
        m = _Mix(1, int(round(mass.sum())), [str(i) for i in range(a * b)], n, least, mass, margins)
        q = quotas(m, rng.poisson(mass).astype(float))
        assert (q <= n).all() and (q >= least).all() and (np.abs(q - mass) <= 1).all()
        assert all(np.max(np.abs(np.bincount(k, q) - np.bincount(k, mass))) <= 1.0 + 1e-6 for k in at) and abs(q.sum() - m.size) <= 1


def test_unknown_column_is_reported(spark):
    sample, report = run(spark, [("create", "direct")], [(1, "task", "colour", "red", 1000, 1, 0), (2, "task", None, None, 1000, 1, 0)])
    assert sample == [] and not any(r.dims_known for r in report.values()) and report[1, "red"].gap == 1


def test_empty_pool_empty_targets_and_null_numbers(spark):
    sample, report = run(spark, [], [(1, "task", "operation", "create", 1000, 10, None)])
    assert sample == [] and report[1, "create"].gap == 10
    sample, report = run(spark, [("create", "direct")], [])
    assert sample == [] and report == {}
    sample, report = run(spark, [("create", "direct")], [(1, "task", "operation", "create", None, None, None)])
    assert sample == [] and report[1, "create"].wanted == 0


def test_same_draw_whatever_the_partitions(spark):
    rows = [("create" if i % 3 else "update", "direct") for i in range(600)]
    targets = spark.createDataFrame([(1, "task", "operation", "create", 500, 100, 0, 1), (1, "task", "operation", "update", 500, 100, 0, 1)], TARGETS)
    draws = [
        {r.rec_key for r in match_proportions(spark, pool(spark, rows).repartition(n), targets, DIMS).sample.collect()} for n in (1, 7)
    ]
    assert draws[0] == draws[1] and len(draws[0]) == 100


def test_raking_meets_both_margins():
    counts = np.array([30.0, 10.0, 20.0, 40.0])  # cells (a, x), (a, y), (b, x), (b, y)
    free = np.zeros(4), np.full(4, 1e9)
    mass = rake(counts, [(np.array([0, 0, 1, 1]), np.array([60.0, 40.0])), (np.array([0, 1, 0, 1]), np.array([50.0, 50.0]))], *free)
    assert mass[:2].sum() == pytest.approx(60) and mass[[0, 2]].sum() == pytest.approx(50)
    odds = lambda m: m[0] * m[3] / (m[1] * m[2])
    assert odds(mass) == pytest.approx(odds(counts))  # raking keeps the association
