"""Bags of rows compared by sums of hashes, against exceptAll."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from quire.operators import fingerprints, tables

SCHEMA = "k int, s string, x double"


def bag(rng, n):
    return [(rng.choice([None, 1, 2, 3, rng.randrange(50)]), rng.choice([None, "", "a", "b", "é"]), rng.choice([None, 0.0, -0.0, 1.5, float("nan")])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("by", [None, ["k"]])
def test_differences_equal_except_all(spark, seed, by):
    rng = random.Random(seed)
    left = bag(rng, 200)
    right = left[:]
    rng.shuffle(right)
    for _ in range(seed):  # seed 0: the same rows in another order
        right.pop()
        right += [rng.choice(left), *bag(rng, 1)]
    a, b = spark.createDataFrame(left, SCHEMA).repartition(3), spark.createDataFrame(right, SCHEMA)
    assert fingerprints.same_rows(a, b) == (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()) == tables.same_rows(a, b)
    got = Counter()
    for r in fingerprints.differences(a, b, by, 16).collect():
        got[r.side, str((r.k, r.s, abs(r.x) if r.x is not None else None))] += r.n
    want = Counter(("a", str((r.k, r.s, abs(r.x) if r.x is not None else None))) for r in a.exceptAll(b).collect())
    want += Counter(("b", str((r.k, r.s, abs(r.x) if r.x is not None else None))) for r in b.exceptAll(a).collect())
    assert got == want and bool(got) == (not fingerprints.same_rows(a, b))


def test_repeated_rows_count(spark):
    df = lambda *r: spark.createDataFrame(list(r), "k int")
    assert fingerprints.same_rows(df((1,), (1,), (2,)), df((2,), (1,), (1,)))
    assert not fingerprints.same_rows(df((1,), (1,), (2,)), df((1,), (2,), (2,)))
    assert not fingerprints.same_rows(df((1,), (1,)), df((1,)))
    assert not fingerprints.same_rows(df((1,), (1,)), df())
    assert fingerprints.same_rows(df(), df())


def test_types_and_names_follow_the_position(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, s string"), spark.createDataFrame([(1, "x")], "other long, t string")
    assert fingerprints.same_rows(a, b)
    with pytest.raises(ValueError, match="columns"):
        fingerprints.same_rows(a, a.select("k"))


def test_equal_tables_shuffle_sums_only(spark):
    a = spark.range(1000).selectExpr("id", "id % 7 AS v")
    plan = fingerprints.fingerprints(a, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(range" in plan and "partial_sum" in plan
    assert fingerprints.differences(a, a.orderBy("v"), ["id"]).collect() == []
    b = a.selectExpr("id", "CASE WHEN id = 500 THEN 100 ELSE v END AS v")
    assert len(fingerprints.differing_ranges(a, b, ["id"])) == 1
    assert sorted(tuple(r) for r in fingerprints.differences(a, b, ["id"]).collect()) == [(500, 3, "a", 1), (500, 100, "b", 1)]
