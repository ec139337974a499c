"""Absolute score of a wallet from its own fills and candles, without a cohort.

Everything is an aggregate or a window over a wallet's days, so wallets are
independent; only days, lots' ends and fills are shuffled, each by its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewise.functions import kernels as k
from tapewise.operators.asof import asof_join
from tapewise.operators.fifo import round_trips

DAY_US = 86_400_000_000
BEGIN, LEAST = 10_000.0, 1.0
NEUTRAL = 50.0
# Midpoint and steepness of each measure; False: lower is better.
CURVES = {
    "sharpe_like": (1.0, 1.0, True),
    "return_vol_bps": (80.0, 0.03, False),
    "downside_vol_bps": (60.0, 0.04, False),
    "max_drawdown_pct": (20.0, 0.08, False),
    "recovery_factor": (2.0, 0.5, True),
    "active_days": (15.0, 0.15, True),
    "entry_timing_edge_bps": (5.0, 0.12, True),
    "expectancy_bps": (3.0, 0.2, True),
    "profit_factor": (1.5, 1.0, True),
    "fills": (100.0, 0.02, True),
}
# What makes up a pillar, and the pillars' shares of the whole.
PILLARS = {
    "consistency": {"sharpe_like": 0.40, "return_vol_bps": 0.20, "downside_vol_bps": 0.20, "hit_rate_pct": 0.20},
    "survivability": {"max_drawdown_pct": 0.50, "recovery_factor": 0.30, "active_days": 0.20},
    "timing": {"entry_timing_edge_bps": 0.65, "favorable_entry_rate_pct": 0.35},
    "conviction": {"expectancy_bps": 0.40, "profit_factor": 0.35, "active_days": 0.15, "fills": 0.10},
}
SHARES = {"consistency": 0.30, "survivability": 0.25, "timing": 0.15, "leverage": 0.15, "conviction": 0.15}
# Counts that make the evidence for a pillar full.
EVIDENCE = {"consistency": {"returns": 20}, "survivability": {"active_days": 10, "returns": 20}, "timing": {"edges": 15}, "conviction": {"returns": 20, "fills": 20}}


def _or0(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def measures(fills: DataFrame, candles: DataFrame) -> DataFrame:
    """A row of measures for each trader of ``fills`` (trader_id, coin, fill_dir,
    size, price, us, event_key, fee_usd, closed_pnl_usd); ``candles``: (coin, us, close).

    Null profits count as 0, a trader's equity is rounded to
    6 places (else the order of summing decides what is a gain) and never falls
    below LEAST. Fills
    without a later candle of their coin have no edge, those whose label is
    neither an open nor a close neither edge nor holding time; such measures are 0. Leverage
    isn't known. Repeated fills count as often as they stand. No fills, no rows."""
    day = F.floor(F.col("us") / DAY_US).alias("day")
    days = fills.groupBy("trader_id", day).agg(_or0(F.sum("closed_pnl_usd")).alias("pnl"))
    order = Window.partitionBy("trader_id").orderBy("day")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("equity", F.greatest(F.round(BEGIN + F.sum("pnl").over(so_far), 6), F.lit(LEAST)))
    days = days.withColumns({"peak": F.max("equity").over(so_far), "r": (F.col("equity") / F.lag("equity").over(order) - 1.0) * 1e4})
    r = F.col("r")
    curve = days.groupBy("trader_id").agg(
        F.count("*").alias("active_days"), F.count("r").alias("returns"), _or0(F.avg("r")).alias("expectancy_bps"), _or0(F.stddev_samp("r")).alias("return_vol_bps"),
        _or0(F.stddev_samp(F.when(r < 0, r))).alias("downside_vol_bps"), _or0(F.avg((r > 0).cast("double"))).alias("hit"), F.max((F.col("peak") - F.col("equity")) / F.col("peak") * 100.0).alias("max_drawdown_pct"),
        F.min_by("equity", "day").alias("first"), F.max_by("equity", "day").alias("last"), _or0(F.sum(F.when(r > 0, r))).alias("gains"), _or0(-F.sum(F.when(r < 0, r))).alias("losses"),
    )
    usd = F.abs(F.col("size") * F.col("price"))
    own = fills.groupBy("trader_id").agg(F.count("*").alias("fills"), _or0(F.try_divide(F.stddev_samp(F.when(usd > 0, usd)), F.avg(F.when(usd > 0, usd)))).alias("sizing_cv"))
    held = round_trips(fills, realized_only=False).groupBy("trader_id").agg(F.avg((F.col("exit_us") - F.col("entry_us")) / 3.6e9).alias("avg_holding_hours"))
    label = F.col("fill_dir")
    side = F.when(label.isin("Open Long", "Close Short"), "buy").when(label.isin("Open Short", "Close Long"), "sell")
    # a candle is looked up once for each time of a coin, not for each fill
    times = asof_join(fills.select("coin", "us").distinct(), candles, "coin", "us", ["close"], direction="forward")
    later = fills.select("trader_id", "coin", "us", "price", side.alias("side")).join(times, ["coin", "us"], "left")
    edge = k.entry_edge_bps(F.col("side"), F.col("price"), F.col("asof_close"))
    edges = later.withColumn("edge", edge).groupBy("trader_id").agg(F.count("edge").alias("edges"), _or0(F.avg("edge")).alias("entry_timing_edge_bps"), _or0(F.avg((F.col("edge") > 0).cast("double"))).alias("fav"))
    out = curve.join(own, "trader_id").join(edges, "trader_id").join(held, "trader_id", "left")
    sharpe = F.when(F.col("return_vol_bps") > 1e-9, F.try_divide(F.col("expectancy_bps"), F.col("return_vol_bps"))).otherwise(0.0)
    factor = k.cascade((F.col("losses") > 1e-9, F.try_divide(F.col("gains"), F.col("losses"))), (F.col("gains") > 1e-9, F.lit(5.0)), other=F.lit(1.0))
    gain = F.when(F.col("active_days") >= 2, (F.col("last") / F.col("first") - 1.0) * 100.0 / F.greatest("max_drawdown_pct", F.lit(1.0))).otherwise(0.0)
    out = out.withColumns({"sharpe_like": sharpe, "profit_factor": factor, "recovery_factor": gain, "hit_rate_pct": F.col("hit") * 100.0, "favorable_entry_rate_pct": F.col("fav") * 100.0, "avg_holding_hours": _or0(F.col("avg_holding_hours"))})
    return out.drop("hit", "fav", "first", "last", "gains", "losses")


def metric_score(name: str) -> Column:
    """0 to 100 for a measure: its curve, or the measure itself where it is a share."""
    if name not in CURVES:
        return k.clamp(F.col(name), 0, 100)
    mid, steep, up = CURVES[name]
    norm = k.sigmoid(F.col(name).cast("double"), mid, steep)
    return (norm if up else 1.0 - norm) * 100.0


def score(measured: DataFrame) -> DataFrame:
    """(trader_id, the five pillars, total, style, style_confidence) of ``measures``.

    Leverage is neutral, as fills don't tell it. With fewer than two active days
    all is neutral and the style unknown."""
    few = F.col("active_days") < 2
    none = F.lit(0.0)
    names = sorted({n for parts in PILLARS.values() for n in parts})
    m = {n: F.col(n) for n in ("entry_timing_edge_bps", "expectancy_bps", "favorable_entry_rate_pct", "avg_holding_hours", "profit_factor", "recovery_factor", "sizing_cv", "max_drawdown_pct")}
    m |= {"fills_30d": F.col("fills"), "avg_leverage": none, "leverage_volatility": none}
    # each step is named once, so that no formula is spelled out again in the next
    rows = measured.withColumns({**{f"_{n}": metric_score(n) for n in names}, **{f"_{n}_fit": x for n, x in k.style_fits(m).items()}})
    pillars = {}
    for pillar, parts in PILLARS.items():
        proof = [k.confidence(F.col(n), target) for n, target in EVIDENCE[pillar].items()]
        sure = F.least(*proof) if len(proof) > 1 else proof[0]
        pillars[pillar] = F.when(few, NEUTRAL).otherwise(k.shrink(k.weighted(*((F.col(f"_{n}"), w) for n, w in parts.items())), sure))
    rows = rows.withColumns({**pillars, "leverage": F.lit(NEUTRAL)})
    rows = rows.withColumns({"_best": k.best_styles({n: F.col(f"_{n}_fit") for n in k.STYLES}), "total": k.clamp(k.weighted(*((F.col(p), w) for p, w in SHARES.items())), 0, 100)})
    first, second = F.col("_best")[0], F.col("_best")[1]
    ahead = first["fit"] - second["fit"]
    style = k.cascade((few, "unknown"), (first["fit"] < 0.35, "unknown"), ((first["name"] != "swing") & (ahead < 0.05), "unknown"), other=first["name"])
    sure = k.cascade((few, 0.0), (first["fit"] < 0.35, first["fit"]), other=ahead)
    return rows.select("trader_id", *PILLARS, "leverage", "total", style.alias("style"), sure.alias("style_confidence"))
