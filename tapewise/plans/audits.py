"""Data-quality views, audits and registry queries."""

from tapewise.plans.views import DAY, HOUR, NOW, NOW_SHIP

SQL: dict[str, str] = {}

_ORDER = "(PARTITION BY trader_id, coin ORDER BY us, event_key"
SQL["p_roundtrip_audit"] = f"""WITH wallets AS (SELECT s_suppkey AS trader_id, s_name AS wallet FROM @supplier WHERE s_suppkey % 4 <> 3),
moves AS (SELECT w.wallet, t.trader_id, t.coin, t.us, t.event_key, t.size, t.price, t.closed_pnl_usd, t.fee_usd, t.fill_dir LIKE 'Close%' AS closes, CASE WHEN t.fill_dir IN ('Open Long', 'Close Short') THEN t.size ELSE -t.size END AS delta FROM tape_v t JOIN wallets w ON w.trader_id = t.trader_id WHERE t.us >= {NOW_SHIP - 2500 * DAY} AND t.us <= {NOW_SHIP}),
run AS (SELECT moves.*, SUM(delta) OVER {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after_fill, LAG(us) OVER {_ORDER}) AS prev_us, ROW_NUMBER() OVER (PARTITION BY trader_id, coin ORDER BY us DESC, event_key DESC) AS from_end FROM moves)
SELECT wallet, trader_id, COUNT(*) AS fills, COUNT(*) FILTER (WHERE closes) AS closed_trips, COUNT(*) FILTER (WHERE from_end = 1 AND ABS(after_fill) > 1e-8) AS orphan_opens, COUNT(*) FILTER (WHERE closes AND ABS(after_fill - delta) < 1e-8) AS orphan_closes, ROUND(SUM(CASE WHEN closes THEN COALESCE(closed_pnl_usd, 0e0) - COALESCE(fee_usd, 0e0) ELSE 0e0 END), 2) AS realized_net, ROUND(SUM(CASE WHEN closes THEN ABS(size * price) ELSE 0e0 END), 2) AS close_notional,
ROUND(SUM(CASE WHEN closes THEN COALESCE(closed_pnl_usd, 0e0) - COALESCE(fee_usd, 0e0) ELSE 0e0 END) / NULLIF(SUM(CASE WHEN closes THEN ABS(size * price) ELSE 0e0 END), 0e0), 8) AS net_to_notional, COUNT(*) FILTER (WHERE closes) < 20 AS too_little_evidence, COUNT(*) FILTER (WHERE closes AND closed_pnl_usd IS NULL AND fee_usd IS NULL) AS closes_unenriched, MAX(us - prev_us) AS longest_pause FROM run GROUP BY wallet, trader_id"""
SQL["p_roundtrip_audit_allowlist"] = SQL["p_roundtrip_audit"].replace("WHERE s_suppkey % 4 <> 3", "WHERE LOWER(TRIM(s_name)) IN (SELECT LOWER(TRIM(v)) FROM (VALUES (' Supplier#000000003 '), ('Supplier#3'), ('Supplier#000000007')) a(v)) OR s_suppkey <= 5")

_CHANNELS = {"fills": "fills_v", "trade_ticks": "ticks_v", "positions": "positions_v", "pnl_snapshots": "pnl_v", "market_snapshots": "market_v", "trader_scores": "scores_v"}
_FRESH = " UNION ALL ".join(f"SELECT '{n}' AS channel, COUNT(*) AS row_count, MAX(us) AS max_us, ({NOW} - MAX(us)) / 1e6 AS lag_sec FROM {v}" for n, v in _CHANNELS.items())
SQL["p_freshness"] = f"SELECT channel, row_count, max_us, ROUND(lag_sec, 3) AS lag_sec FROM ({_FRESH}) f"
_HEALTH = f"SELECT channel, max_us, ROUND(lag_sec, 3) AS lag_sec, CASE WHEN max_us IS NULL THEN 'missing' WHEN lag_sec > CASE channel WHEN 'trader_scores' THEN 7200 ELSE 900 END THEN 'critical' WHEN lag_sec > CASE channel WHEN 'trader_scores' THEN 3900 ELSE 300 END THEN 'warn' ELSE 'ok' END AS status FROM ({_FRESH}) f"
SQL["p_channel_health"] = _HEALTH
_SESS = "SELECT us AS connected, nu AS ended, outcome_next AS outcome, (nu - us) / 1e6 AS duration_sec FROM (SELECT us, kind, next_us AS nu, next_kind AS nk, next_outcome AS outcome_next FROM conn_next_v) q WHERE kind = 'ws_connected' AND nk = 'ws_session_cycle_complete'"
SQL["p_sessions"] = _SESS
_GAPS = f"SELECT ended AS gap_start, nc AS gap_end, (nc - ended) / 1e6 AS gap_sec, outcome AS prior_outcome FROM (SELECT ended, outcome, LEAD(connected) OVER (ORDER BY connected) AS nc FROM ({_SESS}) s) g WHERE nc IS NOT NULL AND nc - ended > 60000000"
SQL["p_gaps"] = _GAPS
SQL["p_gap_report"] = f"SELECT gap_start, ROUND(gap_sec / 60e0, 4) AS minutes, prior_outcome FROM ({_GAPS}) g WHERE gap_start > {NOW - 7 * DAY}"
SQL["p_health_summary"] = f"SELECT h.critical, h.warn, h.missing, g.gaps_24h, g.max_gap_sec, c.last_connected FROM (SELECT COUNT(*) FILTER (WHERE status = 'critical') AS critical, COUNT(*) FILTER (WHERE status = 'warn') AS warn, COUNT(*) FILTER (WHERE status = 'missing') AS missing FROM ({_HEALTH}) x) h CROSS JOIN (SELECT COUNT(*) AS gaps_24h, COALESCE(MAX(gap_sec), 0e0) AS max_gap_sec FROM ({_GAPS}) y WHERE gap_start > {NOW - 2 * DAY}) g CROSS JOIN (SELECT MAX(us) AS last_connected FROM conn_v WHERE kind = 'ws_connected') c"

_LATEST = "SELECT trader_id, MAX_BY(total_score, us) AS score, MAX_BY(style, us) AS style, MAX(us) AS us FROM scores_v GROUP BY trader_id"
_RANK = "SELECT trader_id, MAX_BY(discovery_score, us) AS discovery, MAX_BY(promoted, us) AS promoted FROM ranks_v GROUP BY trader_id"
AUDIT = {
    "inventory": "SELECT 'traders' AS item, COUNT(*) AS n FROM traders_v UNION ALL SELECT 'fills', COUNT(*) FROM fills_v UNION ALL SELECT 'scores', COUNT(*) FROM scores_v",
    "today": f"SELECT 'fills' AS item, COUNT(*) AS n FROM fills_v WHERE us >= {NOW - 2 * DAY} AND us < {NOW - DAY} UNION ALL SELECT 'scores', COUNT(*) FROM scores_v WHERE us >= {NOW - 2 * DAY} AND us < {NOW - DAY}",
    "funnel": f"SELECT COUNT(*) AS traders, COUNT(*) FILTER (WHERE wallet_status = 'PROMOTED') AS promoted, COUNT(s.trader_id) AS scored, COUNT(*) FILTER (WHERE s.score >= 60) AS good FROM traders_v t LEFT JOIN ({_LATEST}) s ON s.trader_id = t.trader_id",
    "distribution": f"SELECT CAST(FLOOR(score / 10e0) AS BIGINT) * 10 AS bucket, COUNT(*) AS n FROM ({_LATEST}) s GROUP BY CAST(FLOOR(score / 10e0) AS BIGINT) * 10",
    "percentiles": f"SELECT ROUND(percentile_cont(0.5) WITHIN GROUP (ORDER BY score), 4) AS p50, ROUND(percentile_cont(0.9) WITHIN GROUP (ORDER BY score), 4) AS p90, MAX(score) AS top FROM ({_LATEST}) s",
    "style_mix": f"SELECT style, COUNT(*) AS n, ROUND(AVG(score), 4) AS avg_score FROM ({_LATEST}) s GROUP BY style",
    "top_wallets": f"SELECT trader_id, score FROM (SELECT trader_id, score FROM ({_LATEST}) s ORDER BY score DESC, trader_id LIMIT 40) t",
    "tiers": f"SELECT CASE WHEN discovery >= 72 THEN 'high_quality' WHEN discovery >= 45 THEN 'watchlist' ELSE 'monitored' END AS tier, COUNT(*) AS n FROM ({_RANK}) r GROUP BY CASE WHEN discovery >= 72 THEN 'high_quality' WHEN discovery >= 45 THEN 'watchlist' ELSE 'monitored' END",
    "rank_percentiles": f"SELECT ROUND(percentile_cont(0.5) WITHIN GROUP (ORDER BY discovery), 4) AS p50, ROUND(percentile_cont(0.9) WITHIN GROUP (ORDER BY discovery), 4) AS p90 FROM ({_RANK}) r",
    "alerts": "SELECT coin, COUNT(*) AS n, COUNT(DISTINCT trader_id) AS traders FROM positions_v WHERE leverage > 5 GROUP BY coin",
    "never_scored": f"SELECT t.trader_id FROM traders_v t LEFT JOIN ({_LATEST}) s ON s.trader_id = t.trader_id AND s.us > {NOW - 8 * DAY} WHERE s.trader_id IS NULL",
    "score_gap": f"SELECT ROUND(MAX(gap) / 1e6, 3) AS longest_gap_sec FROM (SELECT us - LAG(us) OVER (PARTITION BY FLOOR(us / {DAY}) ORDER BY us, event_id) AS gap FROM scores_v UNION ALL SELECT lo - LAG(hi) OVER (ORDER BY lo) FROM (SELECT MIN(us) AS lo, MAX(us) AS hi FROM scores_v GROUP BY FLOOR(us / {DAY})) d) g",
    "runs_per_trader": "SELECT runs, COUNT(*) AS traders FROM (SELECT trader_id, COUNT(*) AS runs FROM scores_v GROUP BY trader_id) r GROUP BY runs",
    "daily_activity": "SELECT CAST(ts AS DATE) AS day, COUNT(*) AS fills, COUNT(DISTINCT trader_id) AS traders FROM fills_v GROUP BY CAST(ts AS DATE)",
}
SQL["p_scoring_audit"] = " UNION ALL ".join(f"SELECT '{k}' AS query, COUNT(*) AS n_rows FROM ({v}) q_{k}" for k, v in AUDIT.items())
SQL |= {f"p_scoring_audit_{k}": v for k, v in AUDIT.items()}

SQL["p_whale_discovery"] = """SELECT wallet, ROUND(vlm, 2) AS vlm, CASE WHEN vlm >= 1e9 THEN 'mega' WHEN vlm >= 1e8 THEN 'whale' WHEN vlm >= 1e7 THEN 'large' ELSE 'active' END AS tier,
vlm >= 1e7 AND roi > 0e0 AND (COALESCE(hit >= 55e0, FALSE) OR vlm >= 1e8 OR (vlm >= 5e7 AND roi >= 0.08e0)) AS promote
FROM (SELECT * FROM whales_v WHERE n_orders >= 2 ORDER BY vlm DESC, wallet LIMIT 100) x"""
SQL["p_daily_universe"] = f"SELECT DATE '2024-01-30' AS snapshot_date, t.trader_id, t.wallet_status, r.discovery FROM traders_v t JOIN ({_RANK}) r ON r.trader_id = t.trader_id WHERE r.promoted"
SQL["p_example_latest_metrics"] = "SELECT trader_id, ROUND(MAX_BY(equity, us), 4) AS equity, MAX(us) AS us FROM pnl_v GROUP BY trader_id"
SQL["p_example_sync"] = "SELECT kind, COUNT(*) AS n, MAX(us) AS last_us FROM conn_v GROUP BY kind"
SQL["p_example_queries"] = "SELECT trader_id, discovery_score, us FROM ranks_v ORDER BY us DESC, event_id DESC LIMIT 50"
SQL["k_spec_score_history"] = "SELECT trader_id, ROUND(COALESCE(STDDEV_SAMP(d), 0e0), 6) AS volatility, MIN(d) AS worst, COALESCE(MIN(d) < -15e0, FALSE) AS drop_alert FROM (SELECT trader_id, total_score - LAG(total_score) OVER (PARTITION BY trader_id ORDER BY us, event_id) AS d FROM scores_v) x GROUP BY trader_id"
SQL["k_fill_dir_quality"] = "SELECT trader_id, CASE WHEN missing >= 1e0 THEN 'exclude' WHEN missing > 0.1e0 THEN 'backfill' ELSE 'ok' END AS quality FROM (SELECT trader_id, AVG(CASE WHEN event_id % 9 = 0 OR trader_id % 13 = 0 OR (trader_id % 5 = 0 AND event_id % 3 = 0) THEN 1e0 ELSE 0e0 END) AS missing FROM fills_v GROUP BY trader_id) x"
SQL["k_dir_return_pct"] = "SELECT signal_id, ROUND(CASE WHEN reference_price <= 0 THEN 0e0 WHEN direction = 'long' THEN ((confidence + 1e0) / NULLIF(reference_price, 0e0) - 1e0) * 100e0 ELSE (reference_price / NULLIF(confidence + 1e0, 0e0) - 1e0) * 100e0 END, 6) AS pct FROM signals_v"
SQL["k_sim_slip_price"] = "SELECT event_id, ROUND(CASE side WHEN 'buy' THEN price * 1.0005e0 ELSE price * 0.9995e0 END, 8) AS entry, ROUND(CASE side WHEN 'buy' THEN price * 1.0005e0 ELSE price * 0.9995e0 END, 8) AS exit, ROUND(price * size * 0.00045e0, 8) AS fee FROM fills_v"
SQL["k_strategy_match"] = "SELECT s.signal_id, st.name, CASE WHEN st.fade THEN CASE s.direction WHEN 'short' THEN 'long' ELSE 'short' END ELSE s.direction END AS direction FROM signals_v s JOIN (VALUES ('consensus_momentum', FALSE, 60), ('quality_breakout', FALSE, 75), ('regime_fade', TRUE, 55)) st(name, fade, least) ON s.confidence >= st.least AND ((st.fade AND s.regime IN ('crowded', 'volatile')) OR (NOT st.fade AND s.regime = 'trend_expansion') OR (st.name = 'consensus_momentum' AND s.regime = 'balanced'))"
SQL["p_trade_chart_frame"] = f"""WITH f AS (SELECT coin, CAST(FLOOR(us / {HOUR * 4}) AS BIGINT) AS b, ROUND(SUM(CASE WHEN side = 'buy' THEN price * size END) / NULLIF(SUM(CASE WHEN side = 'buy' THEN size END), 0e0), 6) AS buy_vwap, COUNT(*) AS n FROM fills_v GROUP BY coin, CAST(FLOOR(us / {HOUR * 4}) AS BIGINT)), k AS (SELECT coin, CAST(FLOOR(us / {HOUR * 4}) AS BIGINT) AS b, MIN_BY(price, us) AS o, MAX(price) AS h, MIN(price) AS l, MAX_BY(price, us) AS cl FROM market_v GROUP BY coin, CAST(FLOOR(us / {HOUR * 4}) AS BIGINT)),
s AS (SELECT coin, CAST(FLOOR(us / {HOUR * 4}) AS BIGINT) AS b, ROUND(AVG(ask - bid), 6) AS spread FROM book_v GROUP BY coin, CAST(FLOOR(us / {HOUR * 4}) AS BIGINT))
SELECT f.coin, f.b, f.buy_vwap, f.n, k.o, k.h, k.l, k.cl, s.spread FROM f LEFT JOIN k ON k.coin = f.coin AND k.b = f.b LEFT JOIN s ON s.coin = f.coin AND s.b = f.b"""
