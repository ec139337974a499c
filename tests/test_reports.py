import random

from pyspark.sql import functions as F

from tapewise.operators.running import running
from tapewise.plans import reports


def test_running_by_brute_force(spark):
    """Null keys and values, empty buckets, one bucket and many."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), t, i, rng.choice([None, *range(-4, 5)])) for i, t in enumerate(sorted(rng.randrange(90) for _ in range(150)))]
    want = {}
    for key in ("a", "b", None):
        seen = []
        for k, _, i, v in rows:
            if k == key:
                seen += [] if v is None else [v]
                want[i] = (sum(seen), max(seen), min(seen)) if seen else (None, None, None)
    df = spark.createDataFrame(rows, "k string, t int, i int, v int")
    for width in (1, 10, 1000):
        out = running(df.withColumn("w", F.floor(F.col("t") / width)), ["k"], "w", ["t", "i"], {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v"))})
        assert {r.i: (r.s, r.hi, r.lo) for r in out.collect()} == want, width
    assert running(df.limit(0).withColumn("w", F.col("t")), ["k"], "w", ["t", "i"], {"s": ("sum", F.col("v"))}).count() == 0


def test_running_product_goes_over_buckets(spark):
    df = spark.createDataFrame([("a", i, 1.0 + i / 10) for i in range(6)], "k string, t int, v double")
    out = running(df.withColumn("w", F.floor(F.col("t") / 2)), ["k"], "w", ["t"], {"p": ("product", F.col("v"))}).orderBy("t").collect()
    p = 1.0
    for r in out:
        p *= r.v
        assert abs(r.p - p) < 1e-12


def test_pages_are_clamped(spark):
    trades = spark.range(1, 601).select(F.lit("s").alias("strategy"), F.col("id").alias("place"))
    places = lambda *a: sorted(r.place for r in reports.page_of(trades, *a).collect())
    assert places(0) == places(-3) == list(range(1, 51))
    assert places(2, 10_000) == list(range(251, 501)) and places(3, 250) == list(range(501, 601))
    assert places(7, 0) == [7] and places(99, 250) == []


def test_streaks_and_drawdown_by_hand(spark):
    """Wins over a border of days count on; the start is a peak."""
    g = [-0.1, 0.2, 0.1, 0.1, -0.05, -0.05]
    equity = [reports.BEGIN]
    for x in g:
        equity.append(equity[-1] * (1 + x))
    rows = [("s", i, i, i // 2, x, e) for i, (x, e) in enumerate(zip(g, equity[1:], strict=True))]
    out = reports._curve(spark.createDataFrame(rows, "strategy string, window_end long, signal_id long, day long, g double, equity double")).orderBy("signal_id").collect()
    assert [r.misses for r in out] == [1, 1, 1, 1, 2, 3] and [r.hits for r in out] == [0, 1, 2, 3, 3, 3]
    assert abs(out[0].drawdown_pct - 10) < 1e-9 and out[3].drawdown_pct == 0 and abs(out[5].drawdown_pct - 9.75) < 1e-9
    assert out[5].trough == equity[1] and out[5].peak == equity[4]
