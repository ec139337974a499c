"""Trader metrics, percentile scores, discovery ranks and the wallet filter."""

from __future__ import annotations

from tapewise.plans.views import DAY, HOUR, MINUTE, NOW

SQL: dict[str, str] = {}


def clamp(x: str, lo: str = "0e0", hi: str = "100e0") -> str:
    return f"LEAST(GREATEST({x}, {lo}), {hi})"


def sig(x: str, mid: float, steep: float) -> str:
    return f"(1e0 / (1e0 + EXP(-{steep}e0 * ({x} - {mid}e0))))"


def bell(x: str, center: float, width: float) -> str:
    return f"EXP(-0.5e0 * POWER(({x} - {center}e0) / {width}e0, 2))"


def conf(n: str, target: int) -> str:
    return clamp(f"SQRT(CAST({n} AS DOUBLE) / {target}e0)", "0e0", "1e0")


def midranks(source: str, columns: dict[str, tuple[str, bool]], name: str, carried: list[str]) -> str:
    """CTEs ``name``: ``carried`` columns of ``source`` with the percentile of each column among all
    rows, ties sharing their mean rank; False: lower is better.

    The columns are turned into rows, so all of them are ranked in one pass
    that is partitioned by column, instead of one global sort each."""
    picks = " ".join(f"WHEN {i} THEN {'' if up else '-'}CAST({c} AS DOUBLE)" for i, (c, up) in enumerate(columns.values()))
    ids = ", ".join(f"({i})" for i in range(len(columns)))
    back = ", ".join(f"MAX(CASE WHEN k = {i} THEN pct END) AS {n}" for i, n in enumerate(columns))
    return f"""{name}_long AS (SELECT trader_id, {', '.join(carried)}, k, CASE k {picks} END AS v FROM {source} CROSS JOIN (VALUES {ids}) AS ks(k)),
{name}_rank AS (SELECT trader_id, {', '.join(carried)}, k, COALESCE((RANK() OVER (PARTITION BY k ORDER BY v) + (COUNT(*) OVER (PARTITION BY k, v) - 1) / 2e0 - 1e0) * 100e0 / NULLIF(COUNT(*) OVER (PARTITION BY k) - 1, 0), 50e0) AS pct FROM {name}_long),
{name} AS (SELECT trader_id, {', '.join(f'MAX({c}) AS {c}' for c in carried)}, {back} FROM {name}_rank GROUP BY trader_id)"""


def mix(*parts: tuple[str, float]) -> str:
    total = round(sum(w for _, w in parts), 6)
    return f"(({' + '.join(f'{x} * {w}e0' for x, w in parts)}) / {total}e0)"


def shrunk(score: str, confidence: str) -> str:
    return clamp(f"50e0 + ({score} - 50e0) * {confidence}")


_SINCE = NOW - 30 * DAY
METRICS = f"""
f AS (SELECT trader_id, COUNT(*) AS fills_30d, CASE WHEN ABS(AVG(price * size)) <= 1e-9 THEN 0e0 ELSE COALESCE(STDDEV_SAMP(price * size), 0e0) / ABS(AVG(price * size)) END AS sizing_cv FROM fills_v WHERE us > {_SINCE} GROUP BY trader_id),
p AS (SELECT trader_id, COUNT(*) AS positions_30d, AVG(ABS(leverage)) AS avg_leverage, MAX(ABS(leverage)) AS max_leverage, COALESCE(STDDEV_SAMP(ABS(leverage)), 0e0) AS leverage_volatility FROM positions_v WHERE us > {_SINCE} GROUP BY trader_id),
curve AS (SELECT trader_id, CAST(FLOOR(us / {HOUR}) AS BIGINT) AS h, MAX_BY(equity, us) AS equity FROM pnl_v WHERE us > {_SINCE} GROUP BY trader_id, CAST(FLOOR(us / {HOUR}) AS BIGINT)),
steps AS (SELECT trader_id, h, equity, LAG(equity) OVER (PARTITION BY trader_id ORDER BY h) AS prev, GREATEST(0e0, MAX(equity) OVER (PARTITION BY trader_id ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM curve),
rets AS (SELECT trader_id, h, equity, CASE WHEN peak > 1e-9 THEN (peak - equity) / peak * 100e0 ELSE 0e0 END AS dd, CASE WHEN ABS(prev) > 1e-9 THEN ROUND((equity / prev - 1e0) * 1e4, 6) END AS r FROM steps),
e AS (SELECT trader_id, COUNT(r) AS n_returns, COALESCE(AVG(r), 0e0) AS expectancy_bps, COALESCE(STDDEV_SAMP(r), 0e0) AS return_vol_bps, COALESCE(STDDEV_SAMP(CASE WHEN r < 0e0 THEN r END), 0e0) AS downside_vol_bps, COALESCE(AVG(CASE WHEN r > 0e0 THEN 1e0 WHEN r IS NOT NULL THEN 0e0 END), 0e0) * 100e0 AS hit_rate_pct,
 MAX(dd) AS max_drawdown_pct, MIN_BY(equity, h) AS first_eq, MAX_BY(equity, h) AS last_eq, COUNT(*) AS points, COALESCE(SUM(CASE WHEN r > 0e0 THEN r END), 0e0) AS gains, COALESCE(-SUM(CASE WHEN r < 0e0 THEN r END), 0e0) AS losses FROM rets GROUP BY trader_id),
segs AS (SELECT trader_id, coin, direction, FLOOR((MAX(us) - MIN(us)) / 1e6) / 3600e0 AS hours FROM (SELECT trader_id, coin, direction, us, SUM(brk) OVER (PARTITION BY trader_id, coin, direction ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM (SELECT trader_id, coin, direction, us, event_id, CASE WHEN us - LAG(us) OVER (PARTITION BY trader_id, coin, direction ORDER BY us, event_id) > {45 * MINUTE} THEN 1 ELSE 0 END AS brk FROM positions_v WHERE us > {_SINCE}) a) b GROUP BY trader_id, coin, direction, seg),
hold AS (SELECT trader_id, AVG(hours) AS avg_holding_hours FROM segs GROUP BY trader_id),
edge AS (SELECT trader_id, COUNT(*) AS n_edges, AVG(x) AS entry_edge, AVG(CASE WHEN x > 0e0 THEN 100e0 ELSE 0e0 END) AS favorable FROM (SELECT trader_id, CASE side WHEN 'buy' THEN (later / GREATEST(ABS(price), 1e0) - 1e0) * 1e4 ELSE (GREATEST(ABS(price), 1e0) / GREATEST(ABS(later), 1e0) - 1e0) * 1e4 END AS x FROM (SELECT trader_id, side, price, LEAD(price) OVER (PARTITION BY coin ORDER BY us, event_id) AS later FROM fills_v WHERE us > {_SINCE}) z WHERE later IS NOT NULL) y GROUP BY trader_id),
days AS (SELECT trader_id, COUNT(DISTINCT CAST(ts AS DATE)) AS active_days_30d FROM (SELECT trader_id, ts, us FROM fills_v UNION ALL SELECT trader_id, ts, us FROM positions_v UNION ALL SELECT trader_id, ts, us FROM pnl_v) u WHERE us > {_SINCE} GROUP BY trader_id),
m AS (SELECT days.trader_id, active_days_30d, fills_30d, positions_30d, n_returns, COALESCE(n_edges, 0) AS n_edges, ROUND(CASE WHEN return_vol_bps <= 1e-9 THEN 0e0 ELSE expectancy_bps / return_vol_bps END, 6) AS sharpe_like, ROUND(return_vol_bps, 4) AS return_vol_bps, ROUND(downside_vol_bps, 4) AS downside_vol_bps, ROUND(hit_rate_pct, 4) AS hit_rate_pct, ROUND(max_drawdown_pct, 4) AS max_drawdown_pct,
 ROUND(CASE WHEN points < 2 OR ABS(first_eq) <= 1e-9 THEN 0e0 ELSE (last_eq / first_eq - 1e0) * 100e0 / GREATEST(max_drawdown_pct, 1e0) END, 6) AS recovery_factor, ROUND(COALESCE(entry_edge, 0e0), 4) AS entry_timing_edge_bps, ROUND(COALESCE(favorable, 0e0), 4) AS favorable_entry_rate_pct, ROUND(avg_leverage, 6) AS avg_leverage, max_leverage, ROUND(leverage_volatility, 6) AS leverage_volatility, ROUND(sizing_cv, 6) AS sizing_cv, ROUND(expectancy_bps, 4) AS expectancy_bps,
 ROUND(CASE WHEN losses <= 1e-9 THEN CASE WHEN gains > 1e-9 THEN 5e0 ELSE 1e0 END ELSE gains / losses END, 6) AS profit_factor, ROUND(COALESCE(avg_holding_hours, 0e0), 6) AS avg_holding_hours
 FROM days JOIN f ON f.trader_id = days.trader_id JOIN p ON p.trader_id = days.trader_id JOIN e ON e.trader_id = days.trader_id LEFT JOIN hold ON hold.trader_id = days.trader_id LEFT JOIN edge ON edge.trader_id = days.trader_id)"""

SQL["p_wallet_metrics"] = f"WITH {METRICS} SELECT * FROM m"

_PCT = {
    "sharpe": ("sharpe_like", True), "rvol": ("return_vol_bps", False), "dvol": ("downside_vol_bps", False), "hit": ("hit_rate_pct", True), "dd": ("max_drawdown_pct", False), "rec": ("recovery_factor", True), "days_p": ("active_days_30d", True), "edge_p": ("entry_timing_edge_bps", True),
    "fav": ("favorable_entry_rate_pct", True), "maxl": ("max_leverage", False), "avgl": ("avg_leverage", False), "lvol": ("leverage_volatility", False), "cv": ("sizing_cv", False), "exp_p": ("expectancy_bps", True), "pf": ("profit_factor", True), "fills_p": ("fills_30d", True),
}
_FITS = {
    "scalp": mix((f"(1e0 - {sig('avg_holding_hours', 4, 0.5)})", 0.45), (sig("fills_30d", 50, 0.04), 0.30), (bell("avg_leverage", 5, 3), 0.15), (f"(1e0 - {sig('sizing_cv', 0.8, 3)})", 0.10)),
    "momentum": "CASE WHEN entry_timing_edge_bps <= 0 OR expectancy_bps <= 0 THEN 0e0 ELSE " + mix((sig("entry_timing_edge_bps", 10, 0.15), 0.40), (sig("expectancy_bps", 5, 0.2), 0.30), (sig("favorable_entry_rate_pct", 55, 0.12), 0.20), (bell("avg_holding_hours", 12, 20), 0.10)) + " END",
    "mean_reversion": "CASE WHEN entry_timing_edge_bps >= 0 OR expectancy_bps <= 0 THEN 0e0 ELSE " + mix((sig("(-entry_timing_edge_bps)", 5, 0.15), 0.40), (sig("expectancy_bps", 3, 0.25), 0.25), (sig("(profit_factor - 1e0)", 0.5, 1.5), 0.20), (sig("recovery_factor", 1, 0.8), 0.15)) + " END",
    "swing": mix((sig("avg_holding_hours", 24, 0.06), 0.45), (f"(1e0 - {sig('fills_30d', 20, 0.08)})", 0.25), (f"(1e0 - {sig('max_drawdown_pct', 15, 0.1)})", 0.20), (f"(1e0 - {sig('leverage_volatility', 3, 0.4)})", 0.10)),
}
SQL["k_style_fits"] = f"WITH {METRICS} SELECT trader_id, {', '.join(f'ROUND({clamp(v, hi="1e0")}, 6) AS {k}' for k, v in _FITS.items())} FROM m"
_TOP = "GREATEST(f0, f1, f2, f3)"
_SECOND = "GREATEST(LEAST(f0, f1), LEAST(f2, f3), LEAST(GREATEST(f0, f1), GREATEST(f2, f3)))"
_BEST = " ".join(f"WHEN f{i} = {_TOP} THEN '{k}'" for i, k in enumerate(_FITS))
STYLE = f"""fits AS (SELECT m.*, {', '.join(f"{clamp(v, hi='1e0')} AS f{i}" for i, v in enumerate(_FITS.values()))} FROM m),
styled AS (SELECT fits.*, CASE WHEN {_TOP} < 0.35e0 OR ((CASE {_BEST} END) <> 'swing' AND {_TOP} - {_SECOND} < 0.05e0) THEN 'unknown' ELSE CASE {_BEST} END END AS style FROM fits)"""
_RET20 = conf("n_returns", 20)
SCORES = f"""{METRICS}, {STYLE},
{midranks('styled', _PCT, 'pc', ['style', 'n_returns', 'active_days_30d', 'n_edges', 'positions_30d', 'fills_30d'])},
pillars AS (SELECT trader_id, style, {shrunk(mix(('sharpe', .4), ('rvol', .2), ('dvol', .2), ('hit', .2)), _RET20)} AS consistency, {shrunk(mix(('dd', .5), ('rec', .3), ('days_p', .2)), f"LEAST({conf('active_days_30d', 10)}, {_RET20})")} AS survivability, {shrunk(mix(('edge_p', .65), ('fav', .35)), conf('n_edges', 15))} AS timing,
 {shrunk(mix(('maxl', .4), ('avgl', .35), ('lvol', .15), ('cv', .1)), conf('positions_30d', 20))} AS leverage, {shrunk(mix(('exp_p', .4), ('pf', .35), ('days_p', .15), ('fills_p', .1)), f"LEAST({_RET20}, {conf('fills_30d + positions_30d', 20)})")} AS conviction FROM pc),
scored AS (SELECT pillars.*, {clamp(mix(('consistency', .3), ('survivability', .25), ('timing', .15), ('leverage', .15), ('conviction', .15)))} AS total FROM pillars)"""
SQL["p_trader_scores"] = f"WITH {SCORES} SELECT trader_id, {', '.join(f'ROUND({x}, 4) AS {x}' for x in ('consistency', 'survivability', 'timing', 'leverage', 'conviction', 'total'))}, style FROM scored"
SQL["p_score_candidates"] = f"""WITH f AS (SELECT trader_id, COUNT(*) AS n FROM fills_v WHERE us > {NOW - 30 * DAY} GROUP BY trader_id), s AS (SELECT trader_id, COUNT(*) AS n, COUNT(DISTINCT CAST(ts AS DATE)) AS d FROM pnl_v WHERE us > {NOW - 30 * DAY} GROUP BY trader_id)
SELECT t.trader_id, t.wallet, f.n AS fills_30d, s.n AS pnl_30d, s.d AS active_days FROM traders_v t JOIN f ON f.trader_id = t.trader_id JOIN s ON s.trader_id = t.trader_id LEFT JOIN (SELECT DISTINCT trader_id FROM ranks_v WHERE promoted) r ON r.trader_id = t.trader_id
WHERE t.last_seen > {NOW - 30 * DAY} AND ((t.filter_updated_us IS NOT NULL AND t.wallet_status = 'PROMOTED') OR (t.filter_updated_us IS NULL AND r.trader_id IS NOT NULL)) AND s.d >= 1 AND f.n >= 8 AND s.n >= 12"""
PROFILE = f"""pv AS (SELECT trader_id, us, event_id, equity - 10000e0 AS pnl FROM pnl_v), pw AS (SELECT trader_id, us, pnl, GREATEST(0e0, MAX(pnl) OVER (PARTITION BY trader_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM pv WHERE us > {NOW - 30 * DAY}),
a AS (SELECT trader_id, AVG(pnl) AS avg_30d, COALESCE(AVG(CASE WHEN us > {NOW - 7 * DAY} THEN pnl END), 0e0) AS avg_7d, COALESCE(STDDEV_SAMP(pnl), 0e0) AS vol, AVG(CASE WHEN pnl > 0e0 THEN 100e0 ELSE 0e0 END) AS win_rate, MAX(CASE WHEN peak > 0e0 THEN (peak - pnl) / peak * 100e0 ELSE 0e0 END) AS dd FROM pw GROUP BY trader_id),
b AS (SELECT trader_id, COUNT(*) FILTER (WHERE us > {NOW - 7 * DAY}) AS fills_7d, COUNT(*) FILTER (WHERE us > {NOW - 30 * DAY}) AS fills_30d, COALESCE(STDDEV_SAMP(size), 0e0) AS sizing FROM fills_v WHERE us > {NOW - 90 * DAY} GROUP BY trader_id),
c AS (SELECT trader_id, AVG(ABS(leverage)) AS lev_avg, MAX(ABS(leverage)) AS lev_peak, COALESCE(STDDEV_SAMP(ABS(leverage)), 0e0) AS lev_vol FROM positions_v WHERE us > {NOW - 30 * DAY} GROUP BY trader_id),
prof AS (SELECT a.trader_id, ROUND({clamp('100e0 - ABS(vol)')}, 4) AS consistency, ROUND(avg_7d, 4) AS avg_pnl_7d, ROUND(avg_30d, 4) AS avg_pnl_30d, ROUND(vol, 4) AS pnl_vol_7d, ROUND(vol, 4) AS pnl_vol_30d, ROUND(win_rate, 4) AS win_rate_30d, ROUND(lev_avg, 4) AS leverage_avg_30d, lev_peak AS leverage_peak_30d, ROUND(lev_vol, 4) AS leverage_vol_30d, ROUND(dd, 4) AS max_drawdown_pct, 0e0 AS avg_hold_secs,
 ROUND({clamp('ABS(vol - avg_30d)')}, 4) AS drift, ROUND({clamp('vol')}, 4) AS emotional, {clamp('fills_7d * 2e0')} AS revenge, ROUND({clamp('sizing')}, 4) AS sizing_instability, ROUND({clamp('avg_7d - avg_30d')}, 4) AS delta, LEAST(fills_30d, 30) AS active_days_30d, fills_7d, fills_30d, CASE WHEN fills_7d > 0 THEN 'active' ELSE 'dormant' END AS lifecycle FROM a JOIN b ON b.trader_id = a.trader_id JOIN c ON c.trader_id = a.trader_id)"""
SQL["p_behavior_profile"] = f"WITH {PROFILE} SELECT * FROM prof"
SQL["p_alerts"] = f"WITH {PROFILE} SELECT trader_id, 'leverage_spike_detected' AS alert, leverage_peak_30d AS metric, 5e0 AS threshold, CAST(trader_id AS STRING) || ':leverage_spike_detected:2024-01-31' AS dedupe_key FROM prof WHERE leverage_peak_30d > 5 UNION ALL SELECT trader_id, 'increasing_emotional_volatility', emotional, 25e0, CAST(trader_id AS STRING) || ':increasing_emotional_volatility:2024-01-31' FROM prof WHERE emotional > 25"

_D = NOW - 2 * DAY
FLOW = f"""flow AS (SELECT buyer AS t, coin, price * size AS notional, us, 1e0 AS is_buy FROM ticks_v WHERE us > {_D} UNION ALL SELECT seller, coin, price * size, us, 0e0 FROM ticks_v WHERE us > {_D}),
fa AS (SELECT t, COUNT(*) FILTER (WHERE us > {NOW - 2 * DAY + 23 * HOUR}) AS n_1h, COUNT(*) AS n_24h, SUM(notional) AS notional_24h, COUNT(DISTINCT coin) AS coins, AVG(is_buy) AS buy_ratio, MAX(us) AS last_us FROM flow GROUP BY t),
ff AS (SELECT trader_id, COUNT(*) AS n FROM fills_v WHERE us > {_D} GROUP BY trader_id), fp AS (SELECT trader_id, COUNT(*) AS n FROM positions_v WHERE us > {_D} GROUP BY trader_id), fs AS (SELECT trader_id, COUNT(*) AS n FROM pnl_v WHERE us > {_D} GROUP BY trader_id),
sc AS (SELECT trader_id, MAX_BY(total_score, us) AS score FROM scores_v WHERE us > {NOW - 5 * DAY} GROUP BY trader_id),
agg AS (SELECT t.trader_id, t.wallet, t.wallet_status, t.filter_updated_us, t.behavior_tier, COALESCE(n_1h, 0) AS trades_1h, COALESCE(n_24h, 0) AS trades_24h, ROUND(COALESCE(notional_24h, 0e0), 4) AS notional_24h, COALESCE(coins, 0) AS coins_24h, ROUND(COALESCE(buy_ratio, 0.5e0), 6) AS buy_ratio, COALESCE(ff.n, 0) AS fills, COALESCE(fp.n, 0) AS positions, COALESCE(fs.n, 0) AS snapshots, last_us, COALESCE(sc.score, 0e0) AS behavior
 FROM traders_v t LEFT JOIN fa ON fa.t = t.trader_id LEFT JOIN ff ON ff.trader_id = t.trader_id LEFT JOIN fp ON fp.trader_id = t.trader_id LEFT JOIN fs ON fs.trader_id = t.trader_id LEFT JOIN sc ON sc.trader_id = t.trader_id WHERE COALESCE(n_24h, 0) + COALESCE(ff.n, 0) + COALESCE(fp.n, 0) + COALESCE(fs.n, 0) > 0)"""
SQL["p_discovery_aggregates"] = f"WITH {FLOW} SELECT * FROM agg"
_AGE = f"CASE WHEN last_us IS NULL THEN 10000e0 ELSE GREATEST(FLOOR(({NOW} - last_us) / 6e7), 0e0) END"
_ACTIVITY = {"a1": ("trades_24h", True), "a2": ("notional_24h", True), "a3": ("coins_24h", True), "a4": ("age", False), "c1": ("fills", True), "c2": ("positions", True), "c3": ("snapshots", True), "c4": ("behavior", True)}
RANKS = f"""{FLOW}, aged AS (SELECT agg.*, {_AGE} AS age, trader_id % 20 = 0 AS whale FROM agg),
{midranks('aged', _ACTIVITY, 'dp', ['wallet', 'wallet_status', 'filter_updated_us', 'behavior_tier', 'fills', 'positions', 'snapshots', 'trades_24h', 'behavior', 'whale'])},
ds AS (SELECT dp.*, {shrunk(mix(('a1', .35), ('a2', .3), ('a3', .2), ('a4', .15)), conf('trades_24h', 25))} AS activity, {shrunk(mix(('c1', .25), ('c2', .25), ('c3', .25), ('c4', .25)), conf('fills + positions + snapshots', 20))} AS coverage, CASE WHEN filter_updated_us IS NOT NULL THEN wallet_status = 'PROMOTED' ELSE whale END AS promoted FROM dp),
dr AS (SELECT ds.*, {clamp(mix(('activity', .55), ('coverage', .45)))} AS discovery FROM ds)"""
SQL["p_discovery_ranks"] = f"""WITH {RANKS} SELECT trader_id, wallet, ROUND(activity, 4) AS activity, ROUND(coverage, 4) AS coverage, ROUND(discovery, 4) AS discovery, promoted, CASE WHEN behavior_tier IS NOT NULL AND behavior_tier <> '' THEN behavior_tier WHEN whale THEN 'whale' WHEN promoted AND behavior >= 80 AND discovery >= 70 THEN 'elite' WHEN promoted AND discovery >= 60 THEN 'active_tracked' WHEN discovery >= 72 THEN 'high_quality' WHEN discovery >= 45 THEN 'watchlist' ELSE 'monitored' END AS tier FROM dr"""
SQL["p_leaderboard"] = f"""SELECT trader_id, wallet, total_score, discovery_score FROM (SELECT t.trader_id, t.wallet, s.total_score, r.discovery_score FROM traders_v t JOIN (SELECT trader_id, MAX_BY(total_score, us) AS total_score, MAX(us) AS us FROM scores_v GROUP BY trader_id) s ON s.trader_id = t.trader_id AND s.us > {NOW - 6 * DAY} JOIN (SELECT trader_id, MAX_BY(discovery_score, us) AS discovery_score FROM ranks_v WHERE promoted GROUP BY trader_id) r ON r.trader_id = t.trader_id WHERE EXISTS (SELECT 1 FROM fills_v f WHERE f.trader_id = t.trader_id) ORDER BY s.total_score DESC, r.discovery_score DESC, t.trader_id LIMIT 25) x"""
SQL["p_scores_with_advisory"] = "SELECT s.trader_id, s.total_score, s.style, a.copyability FROM (SELECT trader_id, MAX_BY(total_score, us) AS total_score, MAX_BY(style, us) AS style FROM scores_v GROUP BY trader_id) s LEFT JOIN (SELECT trader_id, MAX_BY(activity_score, us) AS copyability FROM ranks_v GROUP BY trader_id) a ON a.trader_id = s.trader_id"
SQL["p_trader_detail"] = f"""SELECT t.trader_id, t.wallet, l.n AS leverage_points, ROUND(l.avg_lev, 6) AS avg_leverage, ROUND(d.dd, 4) AS max_dd, ROUND(q.equity, 4) AS last_equity, o.coins FROM traders_v t LEFT JOIN (SELECT trader_id, COUNT(*) AS n, AVG(leverage) AS avg_lev FROM positions_v GROUP BY trader_id) l ON l.trader_id = t.trader_id
LEFT JOIN (SELECT trader_id, MAX((peak - equity) / peak * 100e0) AS dd FROM (SELECT trader_id, equity, MAX(equity) OVER (PARTITION BY trader_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM pnl_v) z WHERE peak > 0e0 GROUP BY trader_id) d ON d.trader_id = t.trader_id
LEFT JOIN (SELECT trader_id, MAX_BY(equity, us) AS equity FROM pnl_v GROUP BY trader_id) q ON q.trader_id = t.trader_id LEFT JOIN (SELECT trader_id, $list(coin) AS coins FROM (SELECT DISTINCT trader_id, coin FROM positions_v WHERE us > {NOW - 3 * DAY}) c GROUP BY trader_id) o ON o.trader_id = t.trader_id WHERE t.trader_id % 10 = 7"""

_MW = f"""w AS (SELECT trader_id, COUNT(*) AS n, MAX(us) AS last_us, (MAX(us) - MIN(us)) / {DAY}e0 AS span, SUM(price * size) AS volume, COALESCE(SUM(CASE WHEN us >= {NOW - 7 * DAY} THEN closed_pnl_usd END), 0e0) AS pnl_7d, COALESCE(SUM(CASE WHEN us >= {NOW - 30 * DAY} THEN closed_pnl_usd END), 0e0) AS pnl_1m, COALESCE(SUM(CASE WHEN us >= {NOW - 90 * DAY} THEN closed_pnl_usd END), 0e0) AS pnl_3m, COUNT(*) FILTER (WHERE us >= {NOW - 30 * DAY}) AS f30, COUNT(*) FILTER (WHERE us >= {NOW - 2 * DAY}) AS f24, COUNT(DISTINCT CASE WHEN us >= {NOW - 7 * DAY} THEN CAST(ts AS DATE) END) AS d7 FROM fills_v GROUP BY trader_id),
x AS (SELECT w.*, t.wallet, t.wallet_status AS old_status, t.trader_id % 20 = 0 AS whale, s.score, COALESCE(s.runs, 0) AS runs FROM w JOIN traders_v t ON t.trader_id = w.trader_id LEFT JOIN (SELECT trader_id, MAX_BY(total_score, us) AS score, COUNT(*) AS runs FROM scores_v GROUP BY trader_id) s ON s.trader_id = w.trader_id),
y AS (SELECT x.*, CASE WHEN n >= 10000 AND span < 30 THEN 'ULTRA_HF_BOT' WHEN n >= 10000 AND span < 90 THEN 'HIGH_FREQUENCY' WHEN n >= 10000 OR span >= 90 THEN 'NORMAL' ELSE 'NEW_WALLET' END AS label, CASE WHEN pnl_3m <> 0e0 THEN pnl_3m WHEN pnl_1m <> 0e0 THEN pnl_1m ELSE pnl_7d END AS sample_pnl,
 LEAST(100e0, LEAST(f30 / 100e0, 1e0) * 35e0 + LEAST(f30 / 30e0, 1e0) * 40e0 + CASE WHEN score IS NOT NULL THEN 25e0 ELSE LEAST(f30 / 50e0, 1e0) * 10e0 END) AS comp, (LEAST(1e0, SQRT(f30 / 50e0)) + LEAST(1e0, SQRT(f30 / 30e0)) + LEAST(1e0, SQRT(f30 / 20e0)) * 2e0) / 5e0 AS cf FROM x),
z AS (SELECT y.*, CASE WHEN old_status = 'BANNED' AND NOT whale THEN 'BANNED' WHEN old_status = 'PROMOTED' THEN 'PROMOTED' WHEN label IN ('ULTRA_HF_BOT', 'HIGH_FREQUENCY') THEN 'BANNED' WHEN whale THEN 'PROMOTED' WHEN ({NOW} - last_us) / {DAY}e0 > 90 OR n < 5 OR volume < 500 OR (pnl_3m <= 0 AND pnl_1m <= 0 AND pnl_7d <= 0) OR sample_pnl <= 0.0005e0 * volume THEN 'PENDING' ELSE 'PROMOTED' END AS status FROM y)"""
SQL["p_wallet_filter"] = f"""WITH {_MW} SELECT trader_id, wallet, label, status, CASE WHEN status <> 'PROMOTED' THEN NULL WHEN score IS NULL THEN 'watchlist' WHEN score >= 75 AND cf >= 0.7e0 AND comp >= 85 THEN 'high_quality' WHEN score >= 40 AND cf >= 0.5e0 THEN 'active_tracked' ELSE 'watchlist' END AS tier, status = 'PROMOTED' AND f30 >= 12 AND comp >= 60 AND cf >= 0.35e0 AS deep_dive,
CASE WHEN status = 'PROMOTED' THEN ROUND(LEAST(100e0, 0.65e0 * (0.4e0 * {clamp('(comp - 40e0) * 2e0')} + 0.3e0 * {clamp('(f30 - 5e0) * 4e0')} + 15e0 * CASE WHEN f30 > 0 THEN 1 ELSE 0 END + 15e0 * CASE WHEN score IS NOT NULL THEN 1 ELSE 0 END) + 0.35e0 * (0.4e0 * {clamp(f'(168e0 - ({NOW} - last_us) / 3.6e9) * 100e0 / 162e0')} + 0.35e0 * {clamp('f24 * 5e0')} + 0.25e0 * {clamp('d7 * 20e0')})), 4) END AS discovery FROM z"""
SQL["p_filter_context"] = f"""SELECT t.trader_id, t.wallet_status, w.wallet IS NOT NULL AS whale, COALESCE(p.n, 0) AS snapshots_30d, s.score, COALESCE(s.runs, 0) AS runs FROM traders_v t LEFT JOIN (SELECT DISTINCT LOWER(wallet) AS wallet FROM registry_v) w ON w.wallet = LOWER(t.wallet)
LEFT JOIN (SELECT trader_id, COUNT(*) AS n FROM pnl_v WHERE us >= {NOW - 30 * DAY} GROUP BY trader_id) p ON p.trader_id = t.trader_id
LEFT JOIN (SELECT trader_id, MAX_BY(total_score, us) AS score, COUNT(*) AS runs FROM scores_v GROUP BY trader_id) s ON s.trader_id = t.trader_id"""
