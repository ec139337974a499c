"""Ranks by ranges against sorting everything."""

import random

import pytest

from tapewise.operators.ranks import By, midrank_percent, row_numbers, value_ranks


def rows(n=400):
    rng = random.Random(3)
    third = [(i, 7.0, "same") for i in range(n // 3)]  # a third of the rows has one value
    rest = [(n // 3 + i, rng.choice([None, float("nan"), float(rng.randrange(40))]), rng.choice([None, "", "a", "b", "é", "Z"])) for i in range(n - n // 3)]
    return third + rest


@pytest.mark.parametrize("ranges", [1, 5, 64])
@pytest.mark.parametrize("order", [[By("id")], [By("v", True, False), By("id")], [By("s", True, False), By("v"), By("id", True)], [By("s", False, False), By("v", True), By("id")]])
def test_row_numbers(spark, order, ranges):
    df = spark.createDataFrame(rows(), "id long, v double, s string").repartition(5)
    got = {r.id: r.place for r in row_numbers(df, order, ranges=ranges).collect()}
    want = [r.id for r in df.coalesce(1).orderBy(*(b.sort() for b in order)).collect()]
    assert got == {x: i + 1 for i, x in enumerate(want)}


def test_ranges_stay_small_beside_a_frequent_value(spark, monkeypatch):
    from tapewise.operators import ranks

    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 5 ELSE id END AS v")
    order = [By("v"), By("id")]
    parts = df.withColumn("_range", ranks._range_of(order, ranks._bounds(df, order, 16))).groupBy("_range").count().collect()
    assert len(parts) == 16 and max(r["count"] for r in parts) < 3 * 3000 / 16


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_value_ranks(spark, ranges):
    data = [(i, v) for i, v, _ in rows()]
    df = spark.createDataFrame(data, "id long, v double")
    key = lambda v: (0, 0.0) if v is None else (2, 0.0) if v != v else (1, v)
    every = [key(v) for _, v in data]
    got = {r.id: (r.below, r.ties, r.total) for r in value_ranks(df, "v", ranges).collect()}
    assert got == {i: (sum(k < key(v) for k in every), every.count(key(v)), len(data)) for i, v in data}


def test_few_rows(spark):
    one = spark.createDataFrame([(1, 4.0)], "id long, v double")
    assert midrank_percent(one, "v").collect()[0].pct == 50.0 and row_numbers(one, [By("id")]).collect()[0].place == 1
    for f in (lambda d: midrank_percent(d, "v"), lambda d: row_numbers(d, [By("v")])):
        assert f(one.limit(0)).collect() == []


def test_no_window_without_a_partition(spark):
    import re

    from tapewise.plans import rank_queries

    for name, query in rank_queries.QUERIES.items():
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "SinglePartition" not in re.sub(r"Exchange SinglePartition, ENSURE_REQUIREMENTS.*?HashAggregate", "", plan), name
