"""Documented pillars, gates and tiers: answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tapewise.functions import spec


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("metric", "given", "want"),
    [
        ("sharpe", -1.0, 0.0), ("sharpe", 0.5, 30.0), ("sharpe", 1.5, 80.0), ("sharpe", 9.0, 100.0),
        ("volatility_bps", 50.0, 100.0), ("volatility_bps", 350.0, 25.0), ("volatility_bps", 501.0, 0.0),
        ("max_drawdown_pct", 5.0, 85.0), ("max_drawdown_pct", 20.0, 40.0), ("max_drawdown_pct", 25.0, 20.0), ("max_drawdown_pct", 30.0, 0.0),
        ("recovery", 0.99, 0.0), ("recovery", 1.0, 30.0), ("recovery", 3.5, 80.0), ("recovery", 10.0, 100.0),
        ("max_leverage", 17.5, 40.0), ("max_leverage", 50.0, 0.0), ("avg_leverage", 20.0, 10.0), ("sizing_cv", 1.1, 25.0),
        ("profit_factor", 1.0, 0.0), ("profit_factor", 2.0, 80.0), ("coins", 3, 60.0), ("median_edge_bps", 4.0, 40.0),
        ("hit_rate", None, None), ("hit_rate", float("nan"), None),
    ],
)
def test_points(spark, metric, given, want):
    got = value(spark, spec.points(metric, F.lit(given)))
    assert got == (pytest.approx(want) if want is not None else None)


def test_the_documented_drawdown(spark):
    rows = [("a", 1, 100.0), ("a", 2, 95.0), ("a", 3, 105.0), ("a", 4, 102.0), ("b", 1, 10.0), ("c", 1, 9.0), ("c", 2, 8.0), ("c", 3, 7.0), ("c", 9, 9.0), ("c", 10, None), ("c", 11, 8.1), ("d", 1, None), ("e", 1, 0.0), ("e", 2, -1.0)]
    got = spec.drawdowns(spark.createDataFrame(rows, "k string, day int, equity double"), "k", "day", "equity")
    assert {r.k: (r.active_days, r.drawdown_days, r.longest_spell, round(r.max_drawdown_pct, 4)) for r in got.collect()} == {"a": (4, 2, 1, 5.0), "b": (1, 0, 0, 0.0), "c": (5, 3, 2, 22.2222), "e": (2, 1, 1, 0.0)}
    assert spec.drawdowns(spark.createDataFrame([], "k string, day int, equity double"), "k", "day", "equity").isEmpty()


def test_missing_metrics_and_pillars_share_their_weight(spark):
    null = F.lit(None).cast("double")
    half = spec.pillar("survivability", {"max_drawdown_pct": F.lit(10.0), "recovery": null, "under_water": F.lit(0.5)})
    assert value(spark, half) == pytest.approx((70 * 0.4 + 50 * 0.2) / 0.6)
    assert value(spark, spec.pillar("timing", {"median_edge_bps": null})) is None
    pillars = {p: null for p in spec.WEIGHTS} | {"consistency": F.lit(80.0), "conviction": F.lit(50.0)}
    score = lambda r, f, d: value(spark, spec.score(pillars, F.lit(r), F.lit(f), F.lit(d)))
    assert score(0.1, 1.2, 5.0) == pytest.approx((80 * 0.25 + 50 * 0.2) / 0.45)
    assert [score(-0.01, 1.2, 5.0), score(0.1, 0.99, 5.0), score(0.1, 1.2, 30.01), score(0.0, None, 30.0)] == [0.0, 0.0, 40.0, pytest.approx(30 / 0.45)]
    assert value(spark, spec.score({p: null for p in spec.WEIGHTS}, F.lit(-1.0), F.lit(0.1), F.lit(99.0))) is None


@pytest.mark.parametrize(("fills", "age", "want"), [(10_000, 29, "ULTRA_HF_BOT"), (10_000, 30, "HIGH_FREQUENCY"), (10_000, 90, "HIGH_FREQUENCY"), (10_000, 91, "NORMAL"), (500, 91, "NORMAL"), (500, 90, "NEW_WALLET"), (0, None, "NEW_WALLET")])
def test_labels(spark, fills, age, want):
    assert value(spark, spec.label(F.lit(fills), F.lit(age).cast("int"))) == want


@pytest.mark.parametrize(
    ("windows", "pnl", "volume", "trades", "last", "want"),
    [
        ((-1.0, -1.0, 0.5), 10.0, 1000.0, 5, 90, None), ((0.0, -1.0, None), 10.0, 1000.0, 5, 90, "LOSS"), ((1.0, 0.0, 0.0), 1.0, 1000.0, 5, 90, "INEFFICIENT"),
        ((1.0, 0.0, 0.0), 1.0, 99.9, 5, 90, "DUST"), ((1.0, 0.0, 0.0), 10.0, 100.0, 4, 90, "FEW_TRADES"), ((1.0, 0.0, 0.0), 10.0, 100.0, 5, 91, "STALE"), ((1.0, 0.0, 0.0), 10.0, 100.0, 5, None, "STALE"),
    ],
)
def test_basic_check(spark, windows, pnl, volume, trades, last, want):
    got = spec.basic_check([F.lit(x).cast("double") for x in windows], F.lit(pnl), F.lit(volume), F.lit(trades), F.lit(last).cast("int"))
    assert value(spark, got) == want


def test_status_tier_and_cold_start(spark):
    status = lambda *a: value(spark, spec.status(*(F.lit(x).cast("string") for x in a)))
    assert [status("BANNED", "NORMAL", None), status("PROMOTED", "ULTRA_HF_BOT", "LOSS"), status("PENDING", "HIGH_FREQUENCY", None), status(None, "NORMAL", None), status(None, "NEW_WALLET", "DUST")] == ["BANNED", "PROMOTED", "BANNED", "PROMOTED", "PENDING"]
    tier = lambda *a: value(spark, spec.tier(F.lit(a[0]), *(F.lit(x).cast("double") for x in a[1:])))
    assert [tier("PROMOTED", 75, 0.7, 85), tier("PROMOTED", 75, 0.7, 84), tier("PROMOTED", 74, 0.5, 99), tier("PROMOTED", 90, 0.49, 99), tier("PROMOTED", 39, 1, 99), tier("PENDING", 90, 1, 99), tier("PROMOTED", None, 1, 99)] == ["high_quality", "active_tracked", "active_tracked", "watchlist", "watchlist", None, None]
    discovery = lambda runs: value(spark, spec.discovery(F.lit(80.0), F.lit(40.0), F.lit(10.0), F.lit(runs).cast("int")))
    assert [discovery(None), discovery(4), discovery(5)] == [pytest.approx(66.0), pytest.approx(66.0), pytest.approx(54.0)]
    assert [value(spark, spec.deep_dive(F.lit(n), F.lit(c))) for n, c in ((24, 70.0), (23, 99.0), (24, 69.9))] == [True, False, False]
