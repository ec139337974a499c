"""Read models: the journal, equity curve and report of a replay, and traders' dossiers.

What grows with the trades (journal, curve) is rows; only what is bounded (regimes,
days of a month, the last alerts) is nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewise.functions import kernels as k
from tapewise.operators.running import running
from tapewise.plans.dialect import duck
from tapewise.plans.dialect import spark as spark_sql
from tapewise.plans.scoring import PROFILE, SCORES
from tapewise.plans.trading import BEGIN, MATCH, replay, rounded
from tapewise.plans.views import DAY, MINUTE, NOW

QUERIES = {}
ORACLE_SQL = {}
c = F.col
#: Fee of a leg, and the rows of a journal's page and the most of it.
FEE_BPS, PAGE, MOST = 4.0, 50, 250
_ORDER = ["window_end", "signal_id"]


def journal(s: SparkSession, d: str) -> DataFrame:
    """A row for each replayed trade, in money.

    ``place`` numbers a strategy's trades by entry time; a running sum by days
    of the entry, so that no task holds a whole strategy."""
    t = replay(s, d).withColumn("equity_before", c("equity") / (1.0 + c("g")))
    per_unit = lambda a, b: F.when(c("dir") == "long", b - a).otherwise(a - b)
    t = t.withColumn("size", c("equity_before") * c("risk") / F.greatest(c("px_in"), F.lit(1.0)))
    gross, raw = c("size") * per_unit(c("px_in"), c("px_out")), c("size") * per_unit(c("in_price"), c("raw_out"))
    t = t.withColumns({"entry_fee": c("size") * c("px_in") * FEE_BPS / 1e4, "exit_fee": c("size") * c("px_out") * FEE_BPS / 1e4, "slippage_paid": F.abs(gross - raw)})
    t = t.withColumns({"pnl": c("equity") - c("equity_before"), "return_pct": c("g") * 100.0, "holding_minutes": F.greatest(F.floor((c("out_us") - c("in_us")) / MINUTE), F.lit(0))})
    t = t.withColumn("in_day", F.floor(c("in_us") / DAY))
    return running(t, ["strategy"], "in_day", ["in_us", "signal_id"], {"place": ("sum", F.lit(1).cast("long"))})


def page_of(trades: DataFrame, page: int, limit: int = PAGE) -> DataFrame:
    """One page of each strategy's journal, from 1; less than 1 counts as 1, and
    a limit is held between 1 and MOST. A page beyond the end is empty."""
    page, limit = max(page, 1), min(max(limit, 1), MOST)
    return trades.where(c("place").between((page - 1) * limit + 1, page * limit))


_JOURNAL = f"""{MATCH}, eb AS (SELECT eq.*, equity / (1e0 + g) AS equity_before FROM eq),
sz AS (SELECT eb.*, equity_before * risk / GREATEST(px_in, 1e0) AS size FROM eb),
jr AS (SELECT sz.*, size * px_in * 4e0 / 1e4 AS entry_fee, size * px_out * 4e0 / 1e4 AS exit_fee, ABS(size * (CASE dir WHEN 'long' THEN px_out - px_in ELSE px_in - px_out END) - size * (CASE dir WHEN 'long' THEN raw_out - raw_in ELSE raw_in - raw_out END)) AS slippage_paid, equity - equity_before AS pnl,
 GREATEST((out_us - in_us) // {MINUTE}, 0) AS holding_minutes, ROW_NUMBER() OVER (PARTITION BY strategy ORDER BY in_us, signal_id) AS place FROM sz)"""


def p_trade_journal(s, d):
    """The whole journal, its pages of PAGE rows numbered."""
    t = journal(s, d)
    out = t.select("strategy", "place", F.ceil(c("place") / PAGE).alias("page"), "signal_id", "coin", "dir", "regime", "reason", c("in_us").alias("opened_us"), c("out_us").alias("closed_us"), "holding_minutes", c("px_in").alias("entry_price"), c("px_out").alias("exit_price"), "size", "entry_fee", "exit_fee", "slippage_paid", c("slip").alias("slippage_bps"), "pnl", "return_pct", (c("mfe") / 100).alias("mfe_pct"), (c("mae") / 100).alias("mae_pct"), "equity_before", c("equity").alias("equity_after"), c("risk").alias("risk_fraction"), "confidence")
    return rounded(out, 4)


_MONEY = "px_in AS entry_price, px_out AS exit_price, size, entry_fee, exit_fee, slippage_paid, slip AS slippage_bps, pnl, g * 100e0 AS return_pct, mfe / 100e0 AS mfe_pct, mae / 100e0 AS mae_pct, equity_before, equity AS equity_after, risk AS risk_fraction"
ORACLE_SQL["p_trade_journal"] = f"""WITH {_JOURNAL} SELECT strategy, place, (place + {PAGE - 1}) // {PAGE} AS page, signal_id, coin, dir, regime, reason, in_us AS opened_us, out_us AS closed_us, holding_minutes, {', '.join(f'ROUND({x.rsplit(" AS ", 1)[0]}, 4) AS {x.rsplit(" AS ", 1)[-1]}' for x in _MONEY.split(', '))}, confidence FROM jr"""


def _curve(trades: DataFrame) -> DataFrame:
    """Trades with the peak and trough of the equity so far, the start included."""
    out = running(trades, ["strategy"], "day", _ORDER, {"peak": ("max", c("equity")), "trough": ("min", c("equity")), "misses": ("sum", (c("g") <= 0).cast("long")), "hits": ("sum", (c("g") > 0).cast("long"))})
    out = out.withColumns({"peak": F.greatest("peak", F.lit(BEGIN)), "trough": F.least("trough", F.lit(BEGIN))})
    return out.withColumn("drawdown_pct", F.when(c("peak") > 0, (c("peak") - c("equity")) / c("peak") * 100.0).otherwise(0.0))


def p_drawdown_curve(s, d):
    """Equity after each trade and how far it is below its peak."""
    return _curve(replay(s, d)).select("strategy", "signal_id", "out_us", k.rounded("equity", 4).alias("equity"), k.rounded("drawdown_pct", 4).alias("drawdown_pct"))


_CURVE = f"""cv AS (SELECT jr.*, GREATEST({BEGIN}, MAX(equity) OVER w) AS peak, LEAST({BEGIN}, MIN(equity) OVER w) AS trough, ROW_NUMBER() OVER (PARTITION BY strategy ORDER BY window_end, signal_id) - ROW_NUMBER() OVER (PARTITION BY strategy, g > 0 ORDER BY window_end, signal_id) AS isle FROM jr WINDOW w AS (PARTITION BY strategy ORDER BY window_end, signal_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
ORACLE_SQL["p_drawdown_curve"] = f"WITH {_JOURNAL}, {_CURVE} SELECT strategy, signal_id, out_us, ROUND(equity, 4) AS equity, ROUND((peak - equity) / peak * 100e0, 4) AS drawdown_pct FROM cv"


def _money(x: Column) -> Column:
    return k.rounded(x, 4).cast("decimal(24,4)")


def _scientific(x: Column) -> Column:
    """As C prints it: infinities in small letters, and no number as what x86 makes of inf - inf."""
    beyond = F.when(F.isnan(x), "-nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.coalesce(beyond, F.format_string("%.6e", x))


def _nested(rows: DataFrame, key: str, by: str, fields: list[str], name: str) -> DataFrame:
    """(key, name): JSON of the few rows of each key, in the order of ``by``."""
    return rows.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(by, *fields)))).alias(name))


def p_simulation_report(s, d):
    """A replay's report: a row for each strategy, its regimes as JSON.

    Streaks are islands: wins between two losses share the number of losses so
    far, and the other way about. No strategy without trades has a row."""
    t = _curve(journal(s, d))
    # by the return: a profit is no number once equity is beyond doubles
    won, lost = c("g") > 0, c("g") <= 0
    sums = t.groupBy("strategy").agg(
        F.count("*").alias("trades"), F.max_by("equity", F.struct(*_ORDER)).alias("ending_equity"), F.max("drawdown_pct").alias("max_drawdown_pct"), F.max("peak").alias("peak_equity"), F.min("trough").alias("trough_equity"),
        F.sum(c("entry_fee") + c("exit_fee")).alias("fees_paid"), F.sum("slippage_paid").alias("slippage_paid"), F.avg(won.cast("double")).alias("wr"), F.coalesce(F.avg(F.when(won, c("return_pct"))), F.lit(0.0)).alias("avg_win_pct"), F.coalesce(F.avg(F.when(lost, c("return_pct"))), F.lit(0.0)).alias("avg_loss_pct"),
        F.avg("return_pct").alias("avg_return_pct"), F.coalesce(F.stddev_samp("return_pct"), F.lit(0.0)).alias("volatility_pct"), F.coalesce(F.sum(F.when(won, c("pnl"))), F.lit(0.0)).alias("gain"), F.coalesce(-F.sum(F.when(c("g") < 0, c("pnl"))), F.lit(0.0)).alias("loss"),
    )
    runs = t.withColumn("isle", F.when(won, c("misses")).otherwise(c("hits"))).groupBy("strategy", won.alias("won"), "isle").agg(F.count("*").alias("n"))
    runs = runs.groupBy("strategy").agg(F.coalesce(F.max(F.when(c("won"), c("n"))), F.lit(0)).alias("longest_wins"), F.coalesce(F.max(F.when(~c("won"), c("n"))), F.lit(0)).alias("longest_losses"))
    regime = t.groupBy("strategy", "regime").agg(F.count("*").alias("trades"), _money(F.avg(won.cast("double")) * 100).alias("win_rate_pct"), _money(F.avg("return_pct")).alias("avg_return_pct"), _scientific(F.sum("pnl")).alias("total_pnl"))
    regime = _nested(regime, "strategy", "regime", ["trades", "win_rate_pct", "avg_return_pct", "total_pnl"], "regimes")
    sharpe = F.when(c("volatility_pct") > 0, c("avg_return_pct") / c("volatility_pct") * F.sqrt("trades")).otherwise(0.0)
    factor = F.when(c("loss") > 0, c("gain") / F.nullif("loss", F.lit(0.0))).otherwise(c("gain"))
    payoff = F.when(c("avg_loss_pct") >= 0, c("avg_win_pct")).otherwise(c("avg_win_pct") / F.greatest(F.abs("avg_loss_pct"), F.lit(1e-4)))
    out = sums.join(runs, "strategy").join(regime, "strategy").withColumns({"win_rate_pct": c("wr") * 100, "total_return_pct": (c("ending_equity") / BEGIN - 1) * 100, "sharpe_like": sharpe, "expectancy": c("avg_win_pct") * c("wr") + c("avg_loss_pct") * (1 - c("wr")), "profit_factor": factor, "payoff_ratio": payoff})
    return rounded(out.drop("wr", "gain", "loss"), 4)


ORACLE_SQL["p_simulation_report"] = f"""WITH {_JOURNAL}, {_CURVE},
su AS (SELECT strategy, COUNT(*) AS trades, LAST(equity ORDER BY window_end, signal_id) AS ending_equity, MAX((peak - equity) / peak * 100e0) AS max_drawdown_pct, MAX(peak) AS peak_equity, MIN(trough) AS trough_equity, SUM(entry_fee + exit_fee) AS fees_paid, SUM(slippage_paid) AS slippage_paid, AVG(CASE WHEN g > 0 THEN 1e0 ELSE 0e0 END) AS wr,
 COALESCE(AVG(CASE WHEN g > 0 THEN g * 100e0 END), 0e0) AS avg_win_pct, COALESCE(AVG(CASE WHEN g <= 0 THEN g * 100e0 END), 0e0) AS avg_loss_pct, AVG(g) * 100e0 AS avg_return_pct, COALESCE(STDDEV_SAMP(g * 100e0), 0e0) AS volatility_pct, COALESCE(SUM(CASE WHEN g > 0 THEN pnl END), 0e0) AS gain, COALESCE(-SUM(CASE WHEN g < 0 THEN pnl END), 0e0) AS loss FROM cv GROUP BY strategy),
ru AS (SELECT strategy, COALESCE(MAX(CASE WHEN won THEN n END), 0) AS longest_wins, COALESCE(MAX(CASE WHEN NOT won THEN n END), 0) AS longest_losses FROM (SELECT strategy, g > 0 AS won, isle, COUNT(*) AS n FROM cv GROUP BY strategy, g > 0, isle) i GROUP BY strategy),
rg AS (SELECT strategy, '[' || STRING_AGG('{{"regime":"' || regime || '","trades":' || n || ',"win_rate_pct":' || w || ',"avg_return_pct":' || r || ',"total_pnl":"' || p || '"}}', ',' ORDER BY regime) || ']' AS regimes FROM (SELECT strategy, regime, COUNT(*) AS n, ROUND(AVG(CASE WHEN g > 0 THEN 1e0 ELSE 0e0 END) * 100e0, 4)::DECIMAL(24,4) AS w, ROUND(AVG(g) * 100e0, 4)::DECIMAL(24,4) AS r, PRINTF('%.6e', SUM(pnl)) AS p FROM cv GROUP BY strategy, regime) q GROUP BY strategy)
SELECT su.strategy, trades, longest_wins, longest_losses, regimes, {', '.join(f'ROUND({x}, 4) AS {x}' for x in ('ending_equity', 'max_drawdown_pct', 'peak_equity', 'trough_equity', 'fees_paid', 'slippage_paid', 'avg_win_pct', 'avg_loss_pct', 'avg_return_pct', 'volatility_pct'))}, ROUND(wr * 100e0, 4) AS win_rate_pct, ROUND((ending_equity / {BEGIN} - 1e0) * 100e0, 4) AS total_return_pct,
 ROUND(CASE WHEN volatility_pct > 0 THEN avg_return_pct / volatility_pct * SQRT(trades) ELSE 0e0 END, 4) AS sharpe_like, ROUND(avg_win_pct * wr + avg_loss_pct * (1e0 - wr), 4) AS expectancy, ROUND(CASE WHEN loss > 0 THEN gain / loss ELSE gain END, 4) AS profit_factor, ROUND(CASE WHEN avg_loss_pct >= 0 THEN avg_win_pct ELSE avg_win_pct / GREATEST(ABS(avg_loss_pct), 1e-4) END, 4) AS payoff_ratio
FROM su JOIN ru ON ru.strategy = su.strategy JOIN rg ON rg.strategy = su.strategy"""


# --- dossiers ---------------------------------------------------------------------------
_SINCE = NOW - 30 * DAY
#: Alerts of a dossier.
ALERTS = 25


def p_trader_dossier(s, d):
    """Each trader's last score, profile and, as JSON, leverage and drawdown by day
    of 30 days and the last ALERTS alerts; null where there are none."""
    read = lambda sql: spark_sql(sql)(s, d)
    day = F.floor(c("us") / DAY).alias("day")
    lev = read(f"SELECT trader_id, us, leverage FROM positions_v WHERE us > {_SINCE}").groupBy("trader_id", day).agg(_money(F.avg(F.abs("leverage"))).alias("leverage"))
    eq = read(f"SELECT trader_id, us, event_id, equity FROM pnl_v WHERE us > {_SINCE}").groupBy("trader_id", day).agg(F.max_by("equity", F.struct("us", "event_id")).alias("equity"))
    by_day = Window.partitionBy("trader_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    eq = eq.withColumn("peak", F.greatest(F.lit(0.0), F.max("equity").over(by_day)))
    dips = eq.withColumn("drawdown_pct", _money(F.when(c("peak") > 0, (c("peak") - c("equity")) / c("peak") * 100).otherwise(0.0)))
    change = eq.groupBy("trader_id").agg((F.max_by("equity", "day") - F.min_by("equity", "day")).alias("equity_change_30d"))
    last = Window.partitionBy("trader_id").orderBy(F.desc("day"), "alert")
    alerts = read("SELECT trader_id, CAST(day AS STRING) AS day, alert FROM alerts_v").withColumn("_n", F.row_number().over(last)).where(c("_n") <= ALERTS)
    t = read("SELECT trader_id, wallet, first_seen, last_seen FROM traders_v")
    seen = {"age_days": F.floor((F.lit(NOW) - c("first_seen")) / DAY), "days_since_seen": F.floor((F.lit(NOW) - c("last_seen")) / DAY)}
    profile = read(f"WITH {PROFILE} SELECT trader_id, avg_pnl_7d, avg_pnl_30d, pnl_vol_30d, win_rate_30d, drift, emotional, revenge, sizing_instability, delta, active_days_30d, fills_7d, fills_30d, lifecycle FROM prof")
    score = read(f"WITH {SCORES} SELECT trader_id, consistency, survivability, timing, leverage AS discipline, conviction, total, style FROM scored")
    out = t.withColumns(seen).drop("first_seen", "last_seen")
    for part in (score, profile, change, _nested(lev, "trader_id", "day", ["leverage"], "leverage_history"), _nested(dips, "trader_id", "day", ["drawdown_pct"], "drawdown_history"), _nested(alerts, "trader_id", "day", ["alert"], "alerts")):
        out = out.join(part, "trader_id", "left")
    return rounded(out, 4)


_SCORE = "consistency, survivability, timing, discipline, conviction, total"
_PROF = "avg_pnl_7d, avg_pnl_30d, pnl_vol_30d, win_rate_30d, drift, emotional, revenge, sizing_instability, delta"
ORACLE_SQL["p_trader_dossier"] = f"""WITH {SCORES}, {PROFILE},
sco AS (SELECT trader_id, consistency, survivability, timing, leverage AS discipline, conviction, total, style FROM scored),
lv AS (SELECT trader_id, '[' || STRING_AGG('{{"day":' || day || ',"leverage":' || v || '}}', ',' ORDER BY day) || ']' AS leverage_history FROM (SELECT trader_id, CAST(FLOOR(us / {DAY}) AS BIGINT) AS day, ROUND(AVG(ABS(leverage)), 4)::DECIMAL(24,4) AS v FROM positions_v WHERE us > {_SINCE} GROUP BY trader_id, CAST(FLOOR(us / {DAY}) AS BIGINT)) q GROUP BY trader_id),
ed AS (SELECT trader_id, CAST(FLOOR(us / {DAY}) AS BIGINT) AS day, LAST(equity ORDER BY us, event_id) AS equity FROM pnl_v WHERE us > {_SINCE} GROUP BY trader_id, CAST(FLOOR(us / {DAY}) AS BIGINT)),
ep AS (SELECT *, GREATEST(0e0, MAX(equity) OVER (PARTITION BY trader_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM ed),
dh AS (SELECT trader_id, LAST(equity ORDER BY day) - FIRST(equity ORDER BY day) AS equity_change_30d, '[' || STRING_AGG('{{"day":' || day || ',"drawdown_pct":' || ROUND(CASE WHEN peak > 0 THEN (peak - equity) / peak * 100e0 ELSE 0e0 END, 4)::DECIMAL(24,4) || '}}', ',' ORDER BY day) || ']' AS drawdown_history FROM ep GROUP BY trader_id),
al AS (SELECT trader_id, '[' || STRING_AGG('{{"day":"' || day || '","alert":"' || alert || '"}}', ',' ORDER BY day) || ']' AS alerts FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY trader_id ORDER BY day DESC, alert) AS n FROM alerts_v) q WHERE n <= {ALERTS} GROUP BY trader_id)
SELECT t.trader_id, t.wallet, ({NOW} - first_seen) // {DAY} AS age_days, ({NOW} - last_seen) // {DAY} AS days_since_seen, {', '.join(f'ROUND(sco.{x}, 4) AS {x}' for x in _SCORE.split(', '))}, style, {', '.join(f'ROUND({x}, 4) AS {x}' for x in _PROF.split(', '))}, active_days_30d, fills_7d, fills_30d, lifecycle, ROUND(equity_change_30d, 4) AS equity_change_30d, leverage_history, drawdown_history, alerts
FROM traders_v t LEFT JOIN sco ON sco.trader_id = t.trader_id LEFT JOIN prof ON prof.trader_id = t.trader_id LEFT JOIN dh ON dh.trader_id = t.trader_id LEFT JOIN lv ON lv.trader_id = t.trader_id LEFT JOIN al ON al.trader_id = t.trader_id"""

QUERIES = {f.__name__: f for f in (p_trade_journal, p_drawdown_curve, p_simulation_report, p_trader_dossier)}
ORACLE_SQL = {n: duck(q) for n, q in ORACLE_SQL.items()}
