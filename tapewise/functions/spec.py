"""Documented absolute scoring: pillars by target values, performance caps, gates,
tiers and the discovery cold start, all as Column expressions.

A metric without data (null or NaN) drops out and the others of its pillar share
its weight; so does a pillar in the whole score. Metrics whose target values
aren't documented aren't scored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Target values as (metric, points), linear between them, and weights.
TARGETS = {
    "sharpe": [(0.0, 0.0), (1.0, 60.0), (2.0, 100.0)],
    "volatility_bps": [(50.0, 100.0), (200.0, 50.0), (500.0, 0.0)],
    "hit_rate": [(0.35, 0.0), (0.50, 50.0), (0.65, 100.0)],
    "max_drawdown_pct": [(0.0, 100.0), (10.0, 70.0), (20.0, 40.0), (30.0, 0.0)],
    "recovery": [(1.0, 30.0), (2.0, 60.0), (5.0, 100.0)],
    "under_water": [(0.0, 100.0), (1.0, 0.0)],
    "median_edge_bps": [(0.0, 0.0), (10.0, 100.0)],
    "max_leverage": [(3.0, 100.0), (10.0, 60.0), (25.0, 20.0), (50.0, 0.0)],
    "avg_leverage": [(2.0, 100.0), (5.0, 60.0), (15.0, 20.0), (25.0, 0.0)],
    "leverage_sd": [(1.0, 100.0), (5.0, 50.0), (15.0, 0.0)],
    "sizing_cv": [(0.3, 100.0), (0.7, 50.0), (1.5, 0.0)],
    "expectancy_bps": [(0.0, 0.0), (10.0, 50.0), (50.0, 100.0)],
    "profit_factor": [(1.0, 0.0), (1.5, 60.0), (2.5, 100.0)],
    "coins": [(1.0, 0.0), (3.0, 60.0), (5.0, 100.0)],
}
PILLARS = {
    "consistency": {"sharpe": 0.35, "volatility_bps": 0.20, "hit_rate": 0.20},
    "survivability": {"max_drawdown_pct": 0.40, "recovery": 0.25, "under_water": 0.20},
    "timing": {"median_edge_bps": 0.20},
    "leverage": {"max_leverage": 0.39, "avg_leverage": 0.33, "leverage_sd": 0.17, "sizing_cv": 0.11},
    "conviction": {"expectancy_bps": 0.35, "profit_factor": 0.30, "coins": 0.10},
}
WEIGHTS = {"consistency": 0.25, "survivability": 0.25, "conviction": 0.20, "leverage": 0.15, "timing": 0.15}
FILL_LIMIT, BOT_DAYS, NORMAL_DAYS = 10_000, 30, 90
LEAST_VOLUME, LEAST_TRADES, LEAST_YIELD, LAST_TRADE_DAYS = 100.0, 5, 0.001, 90
LEAST_SNAPSHOTS, LEAST_COMPLETENESS = 24, 70.0


def points(metric: str, x: Column) -> Column:
    """Points of a metric's value; below the first recovery target there are none."""
    steps = TARGETS[metric]
    x = x.cast("double")
    out = F.when(x.isNull() | F.isnan(x), F.lit(None).cast("double"))
    out = out.when(x < steps[0][0], F.lit(0.0 if metric == "recovery" else steps[0][1]))
    for (a, pa), (b, pb) in zip(steps, steps[1:], strict=False):
        out = out.when(x < b, F.lit(pa) + (x - a) * F.lit((pb - pa) / (b - a)))
    return out.otherwise(F.lit(steps[-1][1]))


def _mean(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that aren't null; null if none is."""
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    weight = add([F.when(x.isNotNull(), w).otherwise(0.0) for x, w in parts])
    return F.when(weight > 0, add([F.coalesce(x * w, F.lit(0.0)) for x, w in parts]) / weight)


def pillar(name: str, metrics: dict[str, Column]) -> Column:
    return _mean([(points(m, metrics[m]), w) for m, w in PILLARS[name].items()])


def score(pillars: dict[str, Column], total_return: Column, profit_factor: Column, max_drawdown_pct: Column) -> Column:
    """Weighted pillars under the performance caps: 0 after a loss or with losses
    above gains, at most 40 after a drawdown over 30 %. Nulls cap nothing."""
    raw = _mean([(pillars[p], w) for p, w in WEIGHTS.items()])
    cap = F.when((total_return < 0) | (profit_factor < 1), 0.0).when(max_drawdown_pct > 30, 40.0).otherwise(100.0)
    return F.when(raw.isNotNull(), F.least(raw, cap))


def drawdowns(days: DataFrame, key: str, day: str, equity: str) -> DataFrame:
    """A row a key: active_days, drawdown_days (equity below its running maximum),
    longest_spell (most such days in a row) and max_drawdown_pct.

    ``days`` holds a row a key and active day; rows without equity are skipped.
    Spells are islands: days under water share the count of days that weren't."""
    rows = days.where(F.col(equity).isNotNull()).select(key, F.col(day).alias("_day"), F.col(equity).alias("_e"))
    w = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_peak", F.max("_e").over(w)).withColumn("_under", F.col("_e") < F.col("_peak"))
    rows = rows.withColumn("_island", F.count(F.when(~F.col("_under"), 1)).over(w))
    depth = F.when(F.col("_peak") > 0, (F.col("_peak") - F.col("_e")) / F.col("_peak") * 100.0).otherwise(0.0)
    spells = rows.groupBy(key, "_island").agg(F.count("*").alias("_n"), F.count_if("_under").alias("_spell"), F.max(depth).alias("_depth"))
    out = spells.groupBy(key).agg(F.sum("_n").alias("active_days"), F.sum("_spell").alias("drawdown_days"), F.max("_spell").alias("longest_spell"), F.max("_depth").alias("max_drawdown_pct"))
    return out


def label(fills: Column, oldest_days: Column) -> Column:
    """Stage 1 by the number of fills (loaded up to 10,000) and the oldest one's age."""
    full = fills >= FILL_LIMIT
    return F.when(fills.isNull() | (fills == 0) | oldest_days.isNull(), "NEW_WALLET").when(full & (oldest_days < BOT_DAYS), "ULTRA_HF_BOT").when(full & (oldest_days <= NORMAL_DAYS), "HIGH_FREQUENCY").when(oldest_days > NORMAL_DAYS, "NORMAL").otherwise("NEW_WALLET")


def basic_check(windows: list[Column], pnl: Column, volume: Column, trades: Column, last_days: Column) -> Column:
    """Stage 2: null if passed, else the first reason why not. Nulls count as nothing."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    gains = reduce(lambda a, b: a | b, [z(x) > 0 for x in windows])
    fails = [(~gains, "LOSS"), (z(pnl) <= z(volume) * LEAST_YIELD, "INEFFICIENT"), (z(volume) < LEAST_VOLUME, "DUST"), (z(trades) < LEAST_TRADES, "FEW_TRADES"), (last_days.isNull() | (last_days > LAST_TRADE_DAYS), "STALE")]
    return F.coalesce(*(F.when(c, F.lit(why)) for c, why in fails))


def status(known: Column, stage1: Column, reason: Column) -> Column:
    """Stages 0 to 2: banned and promoted wallets stay so, others are evaluated again."""
    return F.when(known.isin("BANNED", "PROMOTED"), known).when(stage1.isin("ULTRA_HF_BOT", "HIGH_FREQUENCY"), "BANNED").when(reason.isNull(), "PROMOTED").otherwise("PENDING")


def deep_dive(snapshots: Column, completeness: Column) -> Column:
    """Stage 3: whether there is enough data for a score."""
    return (F.coalesce(snapshots, F.lit(0)) >= LEAST_SNAPSHOTS) & (F.coalesce(completeness, F.lit(0.0)) >= LEAST_COMPLETENESS)


def tier(state: Column, raw: Column, confidence: Column, completeness: Column) -> Column:
    """Tier of a promoted wallet with a score; null for all others."""
    high = (raw >= 75) & (confidence >= 0.70) & (completeness >= 85)
    active = (raw >= 40) & (confidence >= 0.50)
    return F.when((state == "PROMOTED") & raw.isNotNull(), F.when(high, "high_quality").when(active, "active_tracked").otherwise("watchlist"))


def discovery(coverage: Column, activity: Column, history: Column, runs: Column) -> Column:
    """Coverage and activity at 65 to 35 before the fifth run, then 50, 30 and 20 with history."""
    return F.when(F.coalesce(runs, F.lit(0)) < 5, 0.65 * coverage + 0.35 * activity).otherwise(0.5 * coverage + 0.3 * activity + 0.2 * history)
