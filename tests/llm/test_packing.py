import random
from collections import defaultdict

import pytest

from spanwork.llm.packing import TOKENIZER, best_fit_decreasing, load_tokenizer, pack, token_counts

SPECS = [(1, 10), (2, 64), (3, 1000)]


def counts(spark, sizes):
    return spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc_id long, n_tokens long, piece string")


def check(rows, sizes, specs=SPECS):
    for spec, capacity in specs:
        used, pieces = defaultdict(int), defaultdict(list)
        for r in rows:
            if r.spec_id == spec:
                used[r.container_id] += r.n_tokens
                pieces[r.doc_id].append((r.piece, r.start_token, r.n_tokens))
        assert set(pieces) == set(range(len(sizes))) and max(used.values(), default=0) <= capacity
        for i, n in enumerate(sizes):
            got = sorted(pieces[i])
            assert sum(p[2] for p in got) == (n or 0) and [p[0] for p in got] == list(range(len(got)))
            assert [p[1] for p in got] == [sum(q[2] for q in got[:k]) for k in range(len(got))]  # in order, no gap
            assert len(got) == max(1, -(-(n or 0) // capacity))  # cut only if larger
        yield spec, len(used), -(-sum(n or 0 for n in sizes) // capacity)


@pytest.mark.parametrize("rows,windows", [(20_000, 512), (50, 4)])
def test_rules_hold_and_space_is_used(spark, rows, windows):
    rng = random.Random(1)
    sizes = [rng.choice([0, 1, 3, 5, 9, 10, 11, 40, 63, 64, 65, 200]) for _ in range(600)] + [5000, None, 7, 7, 7]
    out = pack(spark, counts(spark, sizes), "doc_id", SPECS, rows, windows).collect()
    for spec, containers, least in check(out, sizes):
        assert containers <= 1.12 * least + 2, (spec, containers, least)


def test_empty_table_bad_capacity_and_repeated_keys(spark):
    assert pack(spark, counts(spark, []), "doc_id", SPECS).collect() == []
    with pytest.raises(ValueError):
        pack(spark, counts(spark, [1]), "doc_id", [(1, 0)])
    twice = counts(spark, [4]).union(counts(spark, [4])).withColumnRenamed("doc_id", "k")
    assert len(pack(spark, twice, "k", [(1, 10)]).collect()) == 2
    nulls = spark.createDataFrame([(None, 4), (None, 3)], "k long, n_tokens long")
    assert sum(r.n_tokens for r in pack(spark, nulls, "k", [(1, 10)]).collect()) == 7


def test_same_containers_at_a_second_run(spark):
    sizes = [random.Random(2).randint(0, 90) for _ in range(300)]
    runs = [{(r.spec_id, r.doc_id, r.piece, r.container_id) for r in pack(spark, counts(spark, sizes).repartition(n), "doc_id", SPECS, 40, 8).collect()} for n in (1, 5)]
    assert runs[0] == runs[1]


def test_token_counts(spark):
    texts = ["Move the wall by 2.5 m.", "", None, "é" * 50, "word " * 30_000, "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts(df, "doc_id", "text").collect()}
    encode = load_tokenizer(TOKENIZER).encode_ordinary
    assert got == {i: len(encode(t)) if t else 0 for i, t in enumerate(texts)}


def test_best_fit_decreasing_never_overfills():
    rng = random.Random(4)
    for _ in range(50):
        sizes = [rng.randint(0, 20) for _ in range(rng.randint(0, 40))]
        used = defaultdict(int)
        for n, k in zip(sizes, best_fit_decreasing(sizes, 20)):
            used[k] += n
        assert all(u <= 20 for u in used.values())
        assert len([u for u in used.values() if u and u <= 10]) <= 1  # two half-empty ones would have been one
