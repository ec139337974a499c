import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tapewise.functions import kernels as k
from tapewise.functions.factors import FactorRegistry, RankingConfig, rank
from tapewise.operators.asof import asof_join, asof_nearest, range_join
from tapewise.operators.fifo import residual_lots, round_trips
from tapewise.operators import snapshots
from tapewise.operators.merge import changed, insert_ignore, latest, upsert_coalesce
from tapewise.plans.copy_sim import CopyConfig, fold_dynamic, fold_fills, fold_static


def one(spark, **cols):
    row = spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()
    return row.asDict()


def test_asof_includes_equal_times_and_keeps_unmatched(spark):
    left = spark.createDataFrame([("a", 10), ("a", 20), ("b", 5), (None, 7)], "k string, t int")
    right = spark.createDataFrame([("a", 10, 1), ("a", 15, 2), ("b", 9, 3), (None, 7, 4)], "k string, t int, v int")
    back = {(r.k, r.t): r.asof_v for r in asof_join(left, right, "k", "t", ["v"]).collect()}
    assert back == {("a", 10): 1, ("a", 20): 2, ("b", 5): None, (None, 7): None}
    ahead = {(r.k, r.t): r.asof_v for r in asof_join(left, right, "k", "t", ["v"], direction="forward").collect()}
    assert ahead == {("a", 10): 1, ("a", 20): None, ("b", 5): 3, (None, 7): None}
    with pytest.raises(ValueError):
        asof_join(left, right, "k", "t", ["v"], direction="sideways")


@pytest.mark.parametrize(("direction", "shift"), [("backward", 0), ("backward", -7), ("forward", 0), ("forward", 4)])
def test_asof_over_buckets_by_brute_force(spark, direction, shift):
    """Ties, negative times, empty buckets, null keys and times."""
    rng = random.Random(shift)
    left = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-60, 90)]), i) for i in range(120)]
    right = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-30, 60, 4)]), rng.randrange(1000)) for _ in range(40)]
    want = {}
    for key, t, i in left:
        ok = [(x, v) for k2, x, v in right if key is not None and None not in (k2, x, t) and k2 == key and (x <= t + shift if direction == "backward" else x >= t + shift)]
        best = None if not ok else max(x for x, _ in ok) if direction == "backward" else min(x for x, _ in ok)
        want[i] = (best, max((v for x, v in ok if x == best), default=None))
    frames = spark.createDataFrame(left, "k string, t long, i int"), spark.createDataFrame(right, "k string, t long, v int")
    for width in (5, 50, 10**9):
        out = asof_join(*frames, "k", "t", ["v"], direction=direction, shift=shift, width=width)
        assert {r.i: (r.asof_t, r.asof_v) for r in out.collect()} == want, width


def test_nearest_prefers_the_earlier_of_two(spark):
    left = spark.createDataFrame([("a", 10), ("a", 12)], "k string, t int")
    right = spark.createDataFrame([("a", 8, 1), ("a", 13, 2), ("a", 12, 3)], "k string, t int, v int")
    assert {r.t: r.near_v for r in asof_nearest(left, right, "k", "t", ["v"]).collect()} == {10: 1, 12: 3}


def test_range_join_matches_nested_loops(spark):
    rng = random.Random(1)
    spans = [("k", i, a, a + rng.randrange(0, 50)) for i, a in enumerate(rng.randrange(0, 200) for _ in range(20))]
    points = [("k", rng.randrange(0, 260)) for _ in range(80)]
    got = range_join(spark.createDataFrame(spans, "k string, i int, a int, b int"), spark.createDataFrame(points, "k string, t int"), "k", "t", "a", "b", 30)
    want = sorted((i, t) for _, i, a, b in spans for _, t in points if a <= t <= b)
    assert sorted((r.i, r.t) for r in got.select("i", "t").collect()) == want


def deque_trips(tape):
    lots, out = deque(), []
    for is_open, size, key in tape:
        if is_open:
            lots.append([size, key])
            continue
        need, found = size, []
        while need > 1e-9 and lots:
            take = min(need, lots[0][0])
            found.append((lots[0][1], key, take))
            lots[0][0] -= take
            need -= take
            if lots[0][0] <= 1e-9:
                lots.popleft()
        if need <= 1e-9:
            out += found
    return sorted(out), sorted((k, q) for q, k in lots)


def test_fifo_matches_a_deque(spark):
    rng, rows, want, rest = random.Random(7), [], [], []
    for trader in range(40):
        tape = [(rng.random() < 0.55, float(rng.randrange(1, 9)), f"{i:03d}") for i in range(rng.randrange(1, 40))]
        rows += [(trader, "C", "Open Long" if o else "Close Long", q, 10.0 + i, i, key, 1.0, 2.0) for i, (o, q, key) in enumerate(tape)]
        trips, left = deque_trips(tape)
        want += [(trader, *t) for t in trips]
        rest += [(trader, *t) for t in left]
    fills = spark.createDataFrame(rows, "trader_id long, coin string, fill_dir string, size double, price double, us long, event_key string, fee_usd double, closed_pnl_usd double")
    got = round_trips(fills).collect()
    assert sorted((r.trader_id, r.open_key, r.close_key, r.qty) for r in got) == sorted(want)
    assert sorted((r.trader_id, r.open_key, r.left) for r in residual_lots(fills).collect()) == sorted(rest)


def test_fifo_skips_unlabelled_and_handles_empty(spark):
    schema = "trader_id long, coin string, fill_dir string, size double, price double, us long, event_key string, fee_usd double, closed_pnl_usd double"
    assert round_trips(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "C", None, 1.0, 1.0, 1, "a", 0.0, None), (1, "C", "Open Long", 2.0, 1.0, 2, "b", 0.0, None), (1, "C", "Close Long", 2.0, 2.0, 3, "c", 0.0, None)]
    assert [r.qty for r in round_trips(spark.createDataFrame(rows, schema)).collect()] == [2.0]


def test_merges(spark, tmp_path):
    old = spark.createDataFrame([(1, 5, "x"), (2, 6, None)], "id int, v int, w string")
    new = spark.createDataFrame([(2, None, "y"), (3, 7, "z")], "id int, v int, w string")
    assert {tuple(r) for r in upsert_coalesce(old, new, ["id"]).collect()} == {(1, 5, "x"), (2, 6, "y"), (3, 7, "z")}
    assert [r.id for r in insert_ignore(old, new, ["id"]).collect()] == [3]
    same = spark.createDataFrame([(2, 6, None), (1, 5, "q")], "id int, v int, w string")
    assert [r.id for r in changed(old, same, ["id"]).collect()] == [1]
    path = str(tmp_path / "t")
    snapshots.merge(spark, path, old, ["id"], ["v"])
    snapshots.merge(spark, path, spark.createDataFrame([(1, 9, "n")], "id int, v int, w string"), ["id"], ["v"])
    assert {tuple(r) for r in snapshots.read(spark, path).collect()} == {(1, 9, "n"), (2, 6, None)}
    assert latest(old.unionAll(old), ["id"], ["v"]).count() == 2


def test_kernels(spark):
    lit = F.lit
    r = one(spark, edge=k.entry_edge_bps(lit("buy"), lit(100.0), lit(101.0)), hold=k.timing_from_hold(lit(4.0)), low=k.timing_from_hold(lit(3.999)), flat=k.outcome_label(lit(-34.9)), loss=k.outcome_label(lit(-35.0)), miss=k.channel_status(lit(None).cast("double")), age=k.age_minutes(lit(None).cast("long"), 10))
    assert round(r["edge"], 6) == 100.0 and r["hold"] == 92.0 and r["low"] < 46
    assert (r["flat"], r["loss"], r["miss"], r["age"]) == ("flat", "loss", "missing", 10_000.0)


def test_factor_ranking(spark):
    df = spark.createDataFrame([("a", 1.0, 9.0), ("b", 2.0, 5.0), ("c", 3.0, 1.0)], "w string, x double, y double")
    reg = FactorRegistry()
    reg.register("twice", lambda: F.col("x") * 2)
    out = rank(df, "w", reg, RankingConfig({"twice": 0.7, "y": 0.3})).collect()
    assert [r.w for r in sorted(out, key=lambda r: r.place)] == ["c", "b", "a"]
    with pytest.raises(KeyError):
        rank(df, "w", reg, RankingConfig({"none": 1.0})).collect()
    with pytest.raises(ValueError):
        RankingConfig({"x": 0.5})


def test_copy_folds():
    import pandas as pd

    trips = pd.DataFrame({"exit_us": [1, 2, 3], "open_key": "o", "close_key": ["a", "b", "c"], "notional": [1000.0, 50.0, 2000.0], "ret": [0.1, 0.5, -0.05]})
    out = fold_static(trips, CopyConfig())
    assert (out["trips"], out["skipped"]) == (2, 1) and out["ending_equity"] == 10_000 + 100 * 0.1 - 200 * 0.05
    many = pd.concat([trips] * 30, ignore_index=True)
    assert fold_dynamic(many, CopyConfig())["max_drawdown_pct"] <= 100
    fills = pd.DataFrame({"us": [1, 2], "event_key": ["a", "b"], "coin": "C", "price": [10.0, 12.0], "delta": [5.0, -5.0]})
    done = fold_fills(fills, CopyConfig(scale=1.0, fee_rate=0.0))
    assert done == {"fills": 2, "realized": 10.0, "fees": 0.0, "open_coins": 0}


def test_copy_gates_and_verdicts(spark):
    """Answers worked out by hand."""
    rows = [(0.4, 0.09, 0.01, 0.9, 40, 3.0, 1.0), (0.5, 0.002, 0.002, 0.9, 40, 3.0, 1.0), (0.5, 0.0059, 0.002, 0.9, 40, 3.0, 1.0), (0.7, 0.04, 0.03, 0.29, 40, 3.0, 1.0), (0.7, 0.04, 0.03, 0.3, 20, 3.0, 0.2), (0.7, 0.04, 0.03, 0.3, 19, 3.0, 1.0), (0.7, 0.04, 0.03, 0.8, 40, 4.2, 0.2), (0.7, 0.04, 0.03, 0.8, 40, -2.0, 0.5), (0.7, 0.04, 0.03, 0.8, 40, -2.1, 0.5), (0.7, 0.04, 0.03, 0.8, 40, 1.0, 0.0), (0.4, 0.0, 0.0, 0.0, 0, 0.0, 0.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, wr double, gain double, loss double, copy double, n long, dyn double, exch double")
    edge, gate = k.edge_filter(F.col("wr"), F.col("gain"), F.col("loss")), k.copyability_gate(F.col("copy"), F.col("n"))
    got = df.select("i", edge, gate, k.verdict(edge, gate, F.col("dyn"), F.col("exch"), F.col("n"))).orderBy("i").collect()
    low, thin, few, sparse = "WIN_RATE_TOO_LOW", "INSUFFICIENT_EDGE", "INSUFFICIENT_TRIPS", "LOW_COPYABILITY"
    assert [r[1] for r in got] == [low, thin, thin, *["OK"] * 7, low]
    assert [r[2] for r in got] == ["OK", "OK", "OK", sparse, "OK", few, "OK", "OK", "OK", "OK", few]
    assert [r[3] for r in got] == ["FILTERED_EDGE"] * 3 + ["FILTERED_COPYABILITY", "LIVE_CANDIDATE", "FILTERED_COPYABILITY", "MONITOR", "MONITOR", "REVIEW", "MONITOR", "NO_DATA"]
    drain = spark.range(1).select(k.variance_drain_pct(F.lit(20.0), F.lit(50)), k.variance_drain_pct(F.lit(20.0), F.lit(0))).first()
    assert [round(x, 9) for x in drain] == [100.0, 0.0]


def test_position_size(spark):
    """Kelly of 0.6 at 2 to 1 is 0.4, a quarter 0.1; of 0.4 it is 0.1."""
    rows = [(0.6, 2.0, 0.5, 0.0, None), (0.4, 2.0, 1.0, 0.0, None), (0.6, 2.0, 0.5, 0.5, None), (0.9, 9.0, 1.0, 0.01, None), (0.6, 2.0, 0.5, 0.0, 100.0), (0.3, 1.0, 1.0, 0.0, None), (0.6, 0.0, 1.0, 0.0, None), (0.6, 2.0, 0.5, 0.0, 0.5), (0.6, 2.0, 0.0, 0.0, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, win double, payoff double, copy double, stop double, last double")
    size = k.kelly_size(F.col("win"), F.col("payoff"), F.lit(10_000.0), F.col("copy"), F.col("stop"), F.col("last"))
    got = [(round(r.usd, 6), r.bound, r.skip) for r in df.select("i", size.alias("s")).orderBy("i").select("s.*").collect()]
    none = (0.0, "dust", "NEGATIVE_EXPECTANCY")
    assert got == [(500.0, "stop", None), (150.0, "stop", None), (200.0, "stop", None), (1500.0, "max_cap", None), (105.0, "ratchet", None), none, none, (0.525, "dust", "DUST"), (200.0, "stop", None)]


def test_order_classes_tiers_and_promotion(spark):
    orders = [("open", "B", False, "BTC"), ("open", "A", False, "BTC"), ("filled", "A", True, "BTC"), ("filled", "B", True, "BTC"), ("Canceled", "A", False, "BTC"), ("canceled", "B", True, "BTC"), ("canceled", "B", False, "BTC"), ("rejected", "B", False, "BTC"), ("rejected", "B", False, "@7"), ("open", "A", True, " @7 "), ("open", "B", False, "@7"), ("open", "A", False, "@7"), (None, "?", False, "@7x")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(orders)], "i int, status string, side string, ro boolean, coin string")
    kind = k.order_kind(F.col("status"), F.col("side"), F.col("ro"), F.col("coin"))
    got = df.select("i", kind.alias("k"), k.order_ambiguous(F.col("coin"), F.col("ro")).alias("a")).orderBy("i").collect()
    assert [r.k for r in got] == ["long_open", "short_open", "long_close", "short_close", "canceled_short", "canceled_short", "canceled", "long_open", "spot_limit_canceled", "spot_limit_close", "spot_limit_buy", "spot_limit_sell", "other"]
    assert [r.a for r in got] == [True, True, False, False, True, False, True, True, False, False, False, False, True]
    whales = [(2e9, 10.0, 0.01), (2e8, None, 0.2), (6e7, None, 0.08), (6e7, None, 0.07), (3e7, 60.0, 0.01), (3e7, 60.0, 0.0), (5e6, 90.0, 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(whales)], "i int, vlm double, hit double, roi double")
    promote = lambda elite: k.should_promote(F.col("vlm"), F.col("hit"), F.col("roi"), least_volume=1e7, least_hit=55.0, elite=elite)
    got = df.select("i", k.whale_tier(F.col("vlm")), promote(False), promote(True)).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [("mega", True, False), ("whale", True, True), ("large", True, False), ("large", False, False), ("large", True, True), ("large", False, False), ("active", False, False)]


def test_fifo_of_huge_and_tiny_sizes(spark):
    """Two fills of 10^9 units, and very many of a hundredth."""
    schema = "trader_id long, coin string, fill_dir string, size double, price double, us long, event_key string, fee_usd double, closed_pnl_usd double"
    huge = [(1, "C", "Open Long", 1e9, 1.0, 1, "a", 0.0, 0.0), (1, "C", "Close Long", 1e9, 2.0, 2, "b", 0.0, 0.0)]
    tiny = [(2, "C", "Open Long" if i % 2 == 0 else "Close Long", 0.01, 1.0, i, f"{i:06d}", 0.0, 0.0) for i in range(8000)]
    got = round_trips(spark.createDataFrame(huge + tiny, schema)).groupBy("trader_id").agg(F.count("*").alias("n"), F.min("qty").alias("lo"), F.max("qty").alias("hi")).collect()
    assert {r.trader_id: (r.n, r.lo, r.hi) for r in got} == {1: (1, 1e9, 1e9), 2: (4000, 0.01, 0.01)}
