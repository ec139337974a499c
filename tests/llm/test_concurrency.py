"""The concurrency sweep against brute force."""

import datetime as dt
import random

import numpy as np
import pytest

from tapewise.llm.concurrency import RangeAddTree, concurrency, moment, sale_changes

CHANGES = "key long, at long, dn long, dc long"


def brute(rows):
    """Rows of ``concurrency`` by adding up everything before each moment."""
    out = []
    for key in {r[0] for r in rows if r[0] is not None}:
        own = [(a, n or 0, c or 0) for k, a, n, c in rows if k == key and a is not None]
        moments = sorted(t for t in {a for a, _, _ in own} if any(sum(x[i] for x in own if x[0] == t) for i in (1, 2)))
        seen = [(t, sum(n for a, n, _ in own if a <= t), sum(c for a, _, c in own if a <= t)) for t in moments]
        for i, (t, n, c) in enumerate(seen):
            out.append((key, t, seen[i + 1][0] if i + 1 < len(seen) else None, n, c, max(x[1] for x in seen[: i + 1]), c == max(x[2] for x in seen)))
    return sorted(out)


def test_tree_is_an_array_of_sums():
    rng = random.Random(3)
    for size in (1, 2, 3, 7, 8, 33):
        tree, plain = RangeAddTree(size), np.zeros(size, dtype=np.int64)
        for _ in range(4):
            lo = np.array([rng.randrange(size) for _ in range(6)])
            hi = np.array([rng.randint(a, size) for a in lo])
            value = np.array([rng.randint(-9, 9) for _ in lo])
            tree.add(lo, hi, value)
            for a, b, v in zip(lo, hi, value, strict=True):
                plain[a:b] += v
            every = np.arange(size)
            assert tree.values(every).tolist() == plain.tolist()
            assert tree.prefix_max(every).tolist() == np.maximum.accumulate(plain).tolist()
            assert tree.max() == plain.max()


@pytest.mark.parametrize(("span", "fan"), [(86_400, 1024), (100, 2), (7, 3), (1, 2)])
def test_sweep_is_that_of_all_moments(spark, span, fan):
    rng = random.Random(span)
    rows = []
    for key in (-2, 0, 5, 10**12):
        for _ in range(80):
            at, n, c = rng.randrange(-200, 900), rng.randint(1, 3), rng.randint(0, 50)
            rows += [(key, at, n, c), (key, at + rng.randint(0, 300), -n, -c)]
    rows += [(7, 40, 1, 5), (7, 40, -1, -5), (8, 40, 0, 5), (9, 3, None, None), (9, 4, 1, None), (None, 1, 1, 1), (9, None, 1, 1), (6, -3, -1, -2)]
    got = sorted(map(tuple, concurrency(spark.createDataFrame(rows, CHANGES), span, fan).collect()))
    assert got == brute(rows)
    assert not [r for r in got if r[0] == 7] and [r[4] for r in got if r[0] == 8] == [5]


def test_no_rows(spark):
    assert concurrency(spark.createDataFrame([], CHANGES)).collect() == []


def test_moments_without_a_zone_are_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:30:59.9' AS a, TIMESTAMP '2024-03-10 02:30:59.9 UTC' AS b, TIMESTAMP_NTZ '1969-12-31 23:59:30' AS c")
        at = int(dt.datetime(2024, 3, 10, 2, 30, tzinfo=dt.UTC).timestamp())
        assert df.select(moment(df, "a"), moment(df, "b"), moment(df, "c")).first()[:] == (at, at, -60)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_sales(spark):
    day = dt.datetime(2024, 1, 1)
    at = lambda s: day + dt.timedelta(seconds=s)
    t0, week = int(day.replace(tzinfo=dt.UTC).timestamp()), 7 * 86_400
    sales = spark.createDataFrame(
        [
            (1, 10, 1.005, at(61)),  # ends a week after its first shipment
            (1, 10, 1.005, at(61)),  # a repeated row is a sale of its own
            (2, 11, None, at(0)),  # never shipped: never ends
            (3, None, 2.0, at(0)),  # no client
            (4, 99, float("nan"), at(0)),  # a client that isn't known
            (5, 10, 5.0, None),  # no start: no part
            (6, 10, 5.0, at(week + 30)),  # ends in the minute it starts in: no part
            (None, 12, -0.5, at(120)),  # a client without a nation, a sale without an id
        ],
        "sale_id long, client_id long, total double, sold_at timestamp_ntz",
    ).selectExpr("*", "'x' AS key", "1 AS at", "2 AS cents", "3 AS end", "4 AS dn")
    lines = spark.createDataFrame([(1, at(200)), (1, at(119)), (1, None), (3, None), (6, at(0)), (None, at(0)), (4, at(0))], "sale_id long, shipped_at timestamp_ntz").selectExpr("*", "5 AS total", "6 AS client_id")
    clients = spark.createDataFrame([(10, 4), (11, 4), (12, None), (None, 9)], "client_id long, nation_id int").selectExpr("*", "7 AS at", "8 AS key")
    got = sorted(map(tuple, sale_changes(sales, lines, clients).groupBy("key", "at").sum("dn", "dc").collect()))
    own = [(4, t0, 1, 0), (4, t0 + 60, 2, 200), (4, t0 + week + 60, -2, -200), (-1, t0, 2, 200), (-1, t0 + week, -1, 0), (-1, t0 + 120, 1, -50)]
    every = [(-2, t0, 3, 200), (-2, t0 + 60, 2, 200), (-2, t0 + 120, 1, -50), (-2, t0 + week, -1, 0), (-2, t0 + week + 60, -2, -200)]
    assert got == sorted(own + every)
