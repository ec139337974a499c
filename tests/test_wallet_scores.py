import json

import pytest
from pyspark.sql import functions as F

from tapewise.functions import bundle
from tapewise.functions.factors import FactorRegistry, RankingConfig, rank
from tapewise.functions.slippage import LinearBps, SlippageModel
from tapewise.operators.fifo import slipped

FILLS = "trader_id long, coin string, fill_dir string, size double, price double, us long, event_key string, fee_usd double, closed_pnl_usd double"
DAY = bundle.DAY_US


def fill(trader, direction, size, price, day, key, pnl=None, coin="A"):
    return trader, coin, direction, size, price, day * DAY, key, 0.0, pnl


def test_measures_by_hand(spark):
    """Gains and a loss by day, a lot closed in two parts, a candle for one of two coins."""
    rows = [
        fill(1, "Open Long", 2.0, 100.0, 0, "a"),
        fill(1, "Close Long", 1.0, 110.0, 1, "b", 1000.0),
        fill(1, "Close Long", 1.0, 90.0, 2, "c", -1100.0),
        fill(1, "Open Long", 1.0, 50.0, 2, "d", None, "B"),
        fill(1, "odd", 1.0, 50.0, 2, "e", None, "B"),
        fill(2, "Open Short", 1.0, 10.0, 0, "f"),
        fill(3, "Close Long", 1.0, 10.0, 0, "g", -50_000.0),
        fill(3, "Close Long", 1.0, 10.0, 1, "h", 10.0),
    ]
    candles = spark.createDataFrame([("A", 0, 101.0), ("A", DAY, 99.0)], "coin string, us long, close double")
    out = {r.trader_id: r for r in bundle.measures(spark.createDataFrame(rows, FILLS), candles).collect()}
    a = out[1]
    assert (a.active_days, a.returns, a.fills) == (3, 2, 5)
    assert a.expectancy_bps == pytest.approx(0.0) and a.hit_rate_pct == 50.0 and a.profit_factor == pytest.approx(1.0)
    assert a.max_drawdown_pct == pytest.approx(10.0) and a.recovery_factor == pytest.approx(-0.1)
    assert a.avg_holding_hours == pytest.approx(36.0)  # 24 and 48 hours
    assert a.edges == 2 and a.entry_timing_edge_bps == pytest.approx((100.0 + (110 / 99 - 1) * 1e4) / 2) and a.favorable_entry_rate_pct == 100.0
    b = out[2]  # nothing closed, one day
    assert (b.returns, b.avg_holding_hours, b.sharpe_like, b.profit_factor, b.recovery_factor) == (0, 0.0, 0.0, 1.0, 0.0)
    assert out[3].hit_rate_pct == 0.0 and out[3].max_drawdown_pct == 0.0  # the equity's floor holds
    scored = {r.trader_id: r for r in bundle.score(bundle.measures(spark.createDataFrame(rows, FILLS), candles)).collect()}
    assert scored[2].total == 50.0 and scored[2].style == "unknown" and scored[2].style_confidence == 0.0
    assert scored[1].leverage == 50.0 and 0 < scored[1].total < 100
    assert bundle.measures(spark.createDataFrame([], FILLS), candles).count() == 0


def test_metric_scores(spark):
    row = spark.createDataFrame([(1.0, 80.0, 130.0)], "sharpe_like double, return_vol_bps double, hit_rate_pct double")
    got = row.select(*(bundle.metric_score(n).alias(n) for n in row.columns)).first()
    assert tuple(got) == (50.0, 50.0, 100.0)
    worse = spark.createDataFrame([(200.0,)], "return_vol_bps double").select(bundle.metric_score("return_vol_bps").alias("x")).first().x
    assert worse < 5.0


class PerSize(SlippageModel):
    """One basis point for each unit."""

    identifier = "per_size"

    def leg(self, buys, mid):
        return mid * (1 + F.when(buys, F.col("qty")).otherwise(-F.col("qty")) / 1e4)


def test_slippage_models(spark):
    trips = spark.createDataFrame([("long", 100.0, 110.0, 10.0), ("short", 100.0, 90.0, 10.0)], "side string, entry_px double, exit_px double, qty double").withColumns({"fee_open": F.lit(1.0), "fee_close": F.lit(2.0), "entry_us": F.lit(0), "exit_us": F.lit(3_600_000_000)})
    net = lambda model: {r.side: r.net for r in slipped(trips, model).collect()}
    assert net(0.0) == net(LinearBps(-7.0)) == {"long": 97.0, "short": 97.0}
    for model in (10.0, LinearBps(10.0), PerSize()):
        assert net(model)["long"] == pytest.approx(97.0 - 2.1) and net(model)["short"] == pytest.approx(97.0 - 1.9)
    assert LinearBps(5).identifier == "linear_5.00_bps_per_leg"
    assert slipped(trips, 5.0).first().hold_hours == 1.0


def test_ranking_configuration():
    good = {"version": "1", "weights": {"a": 0.6, "b": 0.4}, "factor_caps": {"a": 0.5}, "normalization": "none", "decay_half_life_days": 0}
    assert RankingConfig.of(json.dumps(good)) == RankingConfig({"a": 0.6, "b": 0.4}, {"a": 0.5}, "none", "1", 0)
    for bad in ({"weights": {"a": 0.7}}, {"extra": 1}, {"normalization": "rank"}, {"decay_half_life_days": -1}):
        with pytest.raises(ValueError):
            RankingConfig.of({**good, **bad})
    with pytest.raises(ValueError, match="version"):
        RankingConfig.of({"weights": {"a": 1.0}})


@pytest.mark.parametrize("mode", ["minmax", "zscore", "none"])
def test_ranking_caps_and_constants(spark, mode):
    """a is capped after it is normalised; b is constant, so 0.5 unless it is raw."""
    df = spark.createDataFrame([("x", 10.0, 1.0), ("y", 0.0, 1.0), ("z", 20.0, 1.0)], "k string, a double, b double")
    got = rank(df, "k", FactorRegistry(), RankingConfig({"a": 0.6, "b": 0.4}, {"a": 0.5 if mode != "none" else 9.0}, mode)).collect()
    scores = {r.k: r.score for r in got}
    if mode == "none":
        assert scores == pytest.approx({"x": 0.6 * 9 + 0.4, "y": 0.4, "z": 0.6 * 9 + 0.4})
        assert sorted((r.place, r.k) for r in got) == [(1, "x"), (2, "z"), (3, "y")]
    else:
        assert scores == pytest.approx({"x": 0.5, "y": 0.2, "z": 0.5})


def test_a_null_factor_comes_last(spark):
    df = spark.createDataFrame([("x", None), ("y", 0.0), ("z", 1.0)], "k string, a double")
    got = rank(df, "k", FactorRegistry(), RankingConfig({"a": 1.0})).collect()
    assert sorted((r.place, r.k, r.score) for r in got) == [(1, "z", 1.0), (2, "y", 0.0), (3, "x", None)]
