"""Scans, sinks, filters, joins, aggregates, windows, sorts and set operations."""

from tapewise.plans.views import DAY, HOUR, MINUTE, NOW, NOW_SHIP

SQL: dict[str, str] = {}

# --- scans, sources, sinks -------------------------------------------------
SQL["src_pg_query"] = "SELECT trader_id, wallet, first_seen, last_seen, wallet_status FROM traders_v"
SQL["src_pg_stream_fills"] = f"""SELECT event_key, wallet, coin, side, size, price, us FROM fills_v JOIN (SELECT trader_id AS t, wallet FROM traders_v) w ON t = trader_id
WHERE LOWER(wallet) = 'w7' AND us >= COALESCE(CAST(NULL AS BIGINT), 0) AND us <= {NOW}"""
SQL["src_sub_expand"] = """WITH known AS (SELECT DISTINCT coin FROM market_v WHERE coin IN ('click', 'view')),
fresh AS (SELECT DISTINCT coin FROM market_v WHERE coin NOT LIKE '@%' AND coin NOT LIKE '#%')
SELECT coin FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.coin = f.coin) ORDER BY coin LIMIT 1000"""
SQL["src_leaderboard"] = "SELECT wallet, account_value, vlm FROM leaderboard_v WHERE vlm >= 100000e0 AND account_value >= 1000e0"
SQL["src_spot_meta"] = """WITH pairs AS (SELECT p_partkey AS pair_id, p_partkey % 150 AS base, p_partkey % 25 AS quote FROM @part),
token AS (SELECT DISTINCT p_size AS token_id, 'T' || CAST(p_size AS STRING) AS name FROM @part)
SELECT p.pair_id, COALESCE(b.name || '/' || q.name, '@' || CAST(p.pair_id AS STRING)) AS display FROM pairs p LEFT JOIN token b ON b.token_id = p.base LEFT JOIN token q ON q.token_id = p.quote"""
SQL["norm_fill_rest"] = """SELECT event_id, LOWER('W' || CAST(trader_id AS STRING)) AS wallet, CASE UPPER(SUBSTRING(side, 1, 1)) WHEN 'B' THEN 'buy' ELSE 'sell' END AS side, COALESCE(closed_pnl_usd, 0e0) AS pnl, event_key FROM fills_v"""
SQL["norm_fills_frame"] = """SELECT event_key, us, CASE WHEN fill_dir LIKE '%Long%' OR LOWER(fill_dir) = 'buy' THEN 'LONG' ELSE 'SHORT' END AS side, size, price FROM tape_v"""
SQL["norm_orders"] = "SELECT o_orderkey, LOWER(order_type) AS order_type, status, limit_px, status_us FROM orders_snap_v"
SQL["norm_funding"] = "SELECT event_id, coin, us, ROUND(funding_rate, 6) AS funding_rate FROM market_v WHERE event_id % 60 = 0"
SQL["norm_ledger"] = """SELECT event_id, CASE WHEN value >= 0e0 THEN 'deposit' ELSE 'withdraw' END AS ledger_type, ABS(value) AS usdc, us FROM ev_v WHERE event_type = 'signup'"""
SQL["norm_candles"] = f"""SELECT coin, CAST(FLOOR(us / {HOUR}) AS BIGINT) AS hour_no, MIN(price) AS low, MAX(price) AS high, MIN_BY(price, us) AS open, MAX_BY(price, us) AS close FROM market_v GROUP BY coin, CAST(FLOOR(us / {HOUR}) AS BIGINT)"""
SQL["sink_upsert_merge"] = """WITH old AS (SELECT event_key, closed_pnl_usd AS pnl, fee_usd AS fee, us, 0 AS gen FROM fills_v WHERE event_id % 2 = 0),
new AS (SELECT event_key, CASE WHEN event_id % 4 = 0 THEN NULL ELSE price END AS pnl, fee_usd AS fee, us, 1 AS gen FROM fills_v WHERE event_id % 3 = 0)
SELECT COALESCE(n.event_key, o.event_key) AS event_key, COALESCE(n.pnl, o.pnl) AS pnl, COALESCE(n.fee, o.fee) AS fee, CASE WHEN o.event_key IS NULL THEN 'insert' WHEN n.event_key IS NULL THEN 'keep' ELSE 'update' END AS action
FROM old o FULL OUTER JOIN new n ON n.event_key = o.event_key"""
SQL["sink_insert_ignore"] = """WITH held AS (SELECT DISTINCT event_key FROM fills_v WHERE event_id % 2 = 0), batch AS (SELECT event_key, MIN(us) AS us, MIN(price) AS price FROM fills_v WHERE event_id % 3 = 0 GROUP BY event_key)
SELECT b.event_key, b.us, b.price FROM batch b LEFT ANTI JOIN_HELD"""
SQL["sink_insert_ignore"] = SQL["sink_insert_ignore"].replace("LEFT ANTI JOIN_HELD", "WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.event_key = b.event_key)")
SQL["sink_upsert_if_changed"] = """WITH old AS (SELECT trader_id, wallet_status AS status, CAST(trader_id % 3 AS INT) AS score FROM traders_v), new AS (SELECT trader_id, CASE WHEN trader_id % 6 = 0 THEN 'X' ELSE wallet_status END AS status, CAST(trader_id % 3 AS INT) AS score FROM traders_v WHERE trader_id % 2 = 0)
SELECT n.trader_id, n.status, n.score FROM new n LEFT JOIN old o ON o.trader_id = n.trader_id WHERE o.trader_id IS NULL OR o.status IS DISTINCT FROM n.status OR o.score IS DISTINCT FROM n.score"""
SQL["sink_throttled_touch"] = f"""SELECT t.trader_id, CASE WHEN t.last_seen < b.us - 600000000 THEN b.us ELSE t.last_seen END AS last_seen, t.last_seen < b.us - 600000000 AS touched
FROM traders_v t JOIN (SELECT trader_id, MAX(us) + (trader_id % 2) * {HOUR} AS us FROM fills_v GROUP BY trader_id) b ON b.trader_id = t.trader_id"""
SQL["sink_delete_insert_snapshot"] = """SELECT day, trader_id, n FROM (SELECT CAST(ts AS DATE) AS day, trader_id, COUNT(*) AS n FROM fills_v GROUP BY CAST(ts AS DATE), trader_id) d WHERE day <> DATE '2024-01-15'
UNION ALL SELECT DATE '2024-01-15', trader_id, COUNT(DISTINCT coin) FROM fills_v WHERE CAST(ts AS DATE) = DATE '2024-01-15' GROUP BY trader_id"""
SQL["sink_retention"] = f"""SELECT 'ticks' AS kept, COUNT(*) AS n, MIN(us) AS oldest FROM ticks_v WHERE us >= {NOW - 21 * DAY} UNION ALL SELECT 'market', COUNT(*), MIN(us) FROM market_v WHERE us >= {NOW - 45 * DAY}"""
SQL["sink_reset_state"] = """SELECT trader_id, CASE WHEN wallet_status <> 'BANNED' THEN 'DISCOVERED' ELSE wallet_status END AS wallet_status, CASE WHEN wallet_status <> 'BANNED' THEN NULL ELSE behavior_tier END AS behavior_tier FROM traders_v"""
SQL["sink_range_file"] = f"""SELECT event_id, us, coin FROM market_v WHERE us IS NOT NULL AND us BETWEEN {NOW - 20 * DAY} AND {NOW - 10 * DAY}"""

# --- filters and projections -----------------------------------------------
SQL["flt_optional_params"] = "SELECT trader_id, total_score, us FROM scores_v WHERE (70e0 IS NULL OR total_score >= 70e0) AND (CAST(NULL AS STRING) IS NULL OR style = CAST(NULL AS STRING))"
SQL["flt_status_sentinel"] = f"SELECT signal_id, status FROM (SELECT signal_id, CASE WHEN window_end <= {NOW - 10 * DAY} THEN 'expired' ELSE 'active' END AS status FROM signals_v) s WHERE CASE WHEN '__historical__' = '__historical__' THEN status <> 'active' ELSE TRUE END"
SQL["flt_time_lookback"] = "SELECT days, COUNT(*) AS n FROM fills_v CROSS JOIN (SELECT 1 AS days UNION ALL SELECT 7 UNION ALL SELECT 30) d WHERE us > " + f"{NOW} - days * {DAY} GROUP BY days"
SQL["flt_time_halfopen"] = f"SELECT trader_id, coin, us FROM fills_v WHERE us >= {NOW - 6 * DAY} AND us < {NOW - 5 * DAY}"
SQL["flt_exists_any"] = """SELECT t.trader_id FROM traders_v t WHERE EXISTS (SELECT 1 FROM fills_v f WHERE f.trader_id = t.trader_id AND f.price > 150e0) OR EXISTS (SELECT 1 FROM positions_v p WHERE p.trader_id = t.trader_id AND p.leverage >= 10e0 AND p.coin = 'error') OR EXISTS (SELECT 1 FROM signals_v s WHERE s.signal_id = t.trader_id)"""
SQL["flt_promotion_gate"] = """SELECT t.trader_id, t.wallet FROM traders_v t LEFT JOIN (SELECT DISTINCT trader_id FROM ranks_v WHERE promoted) r ON r.trader_id = t.trader_id
WHERE (t.filter_updated_us IS NOT NULL AND t.wallet_status = 'PROMOTED') OR (t.filter_updated_us IS NULL AND r.trader_id IS NOT NULL)"""
SQL["flt_ilike_side"] = """SELECT event_key, CASE WHEN LOWER(s) LIKE 'buy%' OR LOWER(s) LIKE '%buy' OR UPPER(TRIM(s)) = 'B' THEN size WHEN LOWER(s) LIKE 'sell%' OR LOWER(s) LIKE '%sell' OR UPPER(TRIM(s)) = 'S' OR LOWER(s) LIKE 'a%' THEN -size ELSE size END AS signed_size
FROM (SELECT event_key, size, CASE event_id % 6 WHEN 0 THEN 'BUY' WHEN 1 THEN ' s ' WHEN 2 THEN 'market_sell' WHEN 3 THEN 'Ask' WHEN 4 THEN 'b' ELSE 'other' END AS s FROM fills_v) x"""
SQL["flt_values_allowlist"] = "SELECT t.wallet, t.last_seen FROM traders_v t JOIN (VALUES (' W3 '), ('w12'), ('W77')) AS a(w) ON LOWER(TRIM(a.w)) = t.wallet"
SQL["flt_coin_allowlist"] = "SELECT event_key, coin, price FROM fills_v WHERE coin IN ('click', 'purchase')"
SQL["flt_between_inclusive"] = f"SELECT event_id, coin, price FROM market_v WHERE us BETWEEN {NOW - 3 * DAY} AND {NOW - 2 * DAY}"
SQL["flt_limit_order"] = "SELECT o_orderkey, limit_px FROM orders_snap_v WHERE LOWER(order_type) LIKE '%high%' AND limit_px > 0e0"
SQL["flt_range_split"] = f"SELECT CASE WHEN us < {NOW - 20 * DAY} THEN 'before' WHEN us > {NOW - 10 * DAY} THEN 'after' ELSE 'in_range' END AS part, COUNT(*) AS n FROM market_v GROUP BY 1"
SQL["flt_range_split"] = f"SELECT part, COUNT(*) AS n FROM (SELECT CASE WHEN us < {NOW - 20 * DAY} THEN 'before' WHEN us > {NOW - 10 * DAY} THEN 'after' ELSE 'in_range' END AS part FROM market_v) x GROUP BY part"
SQL["prj_window_bucket"] = f"SELECT event_id, CAST(FLOOR(us / {300 * 1_000_000}) AS BIGINT) * 300 AS bucket_sec FROM positions_v"
SQL["prj_rationale"] = "SELECT signal_id, CAST(signal_id % 9 AS STRING) || ' traders ' || direction || ' ' || coin || ' in ' || regime AS rationale FROM signals_v"

# --- joins -------------------------------------------------------------------
SQL["jn_inner_equi"] = "SELECT f.event_key, f.coin, t.wallet FROM fills_v f JOIN traders_v t ON t.trader_id = f.trader_id WHERE t.wallet_status = 'PROMOTED'"
SQL["jn_left_equi"] = f"SELECT t.trader_id, COALESCE(n, 0) AS fills_24h FROM traders_v t LEFT JOIN (SELECT trader_id, COUNT(*) AS n FROM fills_v WHERE us > {NOW - 2 * DAY} GROUP BY trader_id) f ON f.trader_id = t.trader_id"
SQL["jn_multi_attr_left"] = "SELECT s.signal_id, o.horizon FROM signals_v s LEFT JOIN (SELECT signal_id, 60 AS horizon FROM signals_v WHERE signal_id % 2 = 0 UNION ALL SELECT signal_id, 240 FROM signals_v) o ON o.signal_id = s.signal_id AND o.horizon = 60"
SQL["jn_anti"] = f"SELECT t.trader_id FROM traders_v t WHERE NOT EXISTS (SELECT 1 FROM scores_v s WHERE s.trader_id = t.trader_id AND s.us > {NOW - 4 * DAY})"
SQL["jn_semi"] = "SELECT t.trader_id, t.wallet FROM traders_v t WHERE EXISTS (SELECT 1 FROM ranks_v r WHERE r.trader_id = t.trader_id AND r.promoted)"
SQL["jn_cross_scalar"] = f"SELECT f.trader_id, COUNT(*) AS n FROM fills_v f CROSS JOIN (SELECT {NOW} AS anchor, {NOW - 5 * DAY} AS start_us) p WHERE f.us >= p.start_us AND f.us <= p.anchor GROUP BY f.trader_id"
SQL["jn_lateral_latest"] = """SELECT t.trader_id, s.total_score, s.style, r.discovery_score FROM traders_v t
LEFT JOIN (SELECT trader_id, MAX_BY(total_score, us) AS total_score, MAX_BY(style, us) AS style FROM scores_v GROUP BY trader_id) s ON s.trader_id = t.trader_id
LEFT JOIN (SELECT trader_id, MAX_BY(discovery_score, us) AS discovery_score FROM ranks_v GROUP BY trader_id) r ON r.trader_id = t.trader_id"""
SQL["jn_range_window"] = f"""SELECT s.signal_id, COUNT(m.event_id) AS n, MIN(m.price) AS lo, MAX(m.price) AS hi FROM signals_v s
LEFT JOIN (SELECT event_id, coin, price, us, CAST(FLOOR(us / {4 * HOUR}) AS BIGINT) AS b FROM market_v) m ON m.coin = s.coin AND (m.b = CAST(FLOOR(s.window_end / {4 * HOUR}) AS BIGINT) OR m.b = CAST(FLOOR(s.window_end / {4 * HOUR}) AS BIGINT) + 1) AND m.us BETWEEN s.window_end AND s.window_end + {4 * HOUR} GROUP BY s.signal_id"""
SQL["jn_hash_dimension"] = f"""WITH base AS (SELECT coin, CAST(FLOOR(us / {HOUR}) AS BIGINT) % 24 AS utc_hour, AVG(ask - bid) AS mu, COUNT(*) AS n FROM book_v GROUP BY coin, CAST(FLOOR(us / {HOUR}) AS BIGINT) % 24)
SELECT b.event_id, ROUND(b.ask - b.bid - base.mu, 6) AS excess, base.n FROM book_v b LEFT JOIN base ON base.coin = b.coin AND base.utc_hour = CAST(FLOOR(b.us / {HOUR}) AS BIGINT) % 24"""
SQL["jn_client_hash_attach"] = "SELECT s.signal_id, $list(f.trader_id) AS traders, COUNT(*) AS n FROM signals_v s JOIN fills_v f ON f.coin = s.coin AND f.event_id BETWEEN s.signal_id - 20 AND s.signal_id GROUP BY s.signal_id"
SQL["jn_any_array"] = "SELECT signal_id, coin FROM signals_v WHERE signal_id IN (25, 50, 75, 500)"

# --- aggregates ----------------------------------------------------------------
SQL["agg_filter_clause"] = f"SELECT trader_id, COUNT(*) FILTER (WHERE us > {NOW - 7 * DAY}) AS n_7d, COUNT(*) FILTER (WHERE us > {NOW - 30 * DAY}) AS n_30d, ROUND(COALESCE(SUM(price * size) FILTER (WHERE us > {NOW - 7 * DAY}), 0e0), 4) AS notional_7d, ROUND(AVG(price) FILTER (WHERE side = 'buy'), 6) AS avg_buy FROM fills_v GROUP BY trader_id"
SQL["agg_distinct_filter"] = f"SELECT trader_id, COUNT(DISTINCT CASE WHEN us > {NOW - 5 * DAY} THEN coin END) AS coins FROM fills_v GROUP BY trader_id"
SQL["agg_active_days"] = "SELECT trader_id, COUNT(DISTINCT day) AS active_days FROM (SELECT trader_id, CAST(ts AS DATE) AS day FROM fills_v WHERE event_id % 2 = 0 UNION ALL SELECT trader_id, CAST(ts AS DATE) FROM positions_v WHERE event_id % 3 = 0 UNION ALL SELECT trader_id, CAST(ts AS DATE) FROM pnl_v WHERE event_id % 5 = 0) s GROUP BY trader_id"
SQL["agg_daily_stats"] = "SELECT trader_id, CAST(ts AS DATE) AS stats_date, ROUND(SUM(COALESCE(closed_pnl_usd, 0e0)), 4) AS pnl, COUNT(*) AS trades, ROUND(SUM(ABS(price * size)), 4) AS volume FROM fills_v GROUP BY trader_id, CAST(ts AS DATE)"
_WIN = ", ".join(f"ROUND(SUM(CASE WHEN day >= DATE '{d}' THEN pnl ELSE 0e0 END), 4) AS pnl_{n}d, CAST(SUM(CASE WHEN day >= DATE '{d}' THEN trades ELSE 0 END) AS BIGINT) AS trades_{n}d" for n, d in ((7, "2024-01-24"), (30, "2024-01-01"), (90, "2023-11-02"), (180, "2023-08-04")))
SQL["agg_multi_window"] = f"SELECT trader_id, {_WIN}, MAX(day) AS last_day FROM (SELECT trader_id, CAST(ts AS DATE) AS day, SUM(COALESCE(closed_pnl_usd, 0e0)) AS pnl, COUNT(*) AS trades FROM fills_v GROUP BY trader_id, CAST(ts AS DATE)) d GROUP BY trader_id"
SQL["agg_having"] = f"SELECT coin, CAST(FLOOR(us / {6 * HOUR}) AS BIGINT) AS w, COUNT(DISTINCT trader_id) AS traders FROM positions_v GROUP BY coin, CAST(FLOOR(us / {6 * HOUR}) AS BIGINT) HAVING COUNT(DISTINCT trader_id) >= 5"
SQL["agg_consensus_group"] = f"SELECT p.coin, p.direction, CAST(FLOOR(p.us / {6 * HOUR}) AS BIGINT) AS w, COUNT(DISTINCT p.trader_id) AS traders, ROUND(AVG(s.score), 6) AS avg_score, ROUND(SUM(s.score / 100e0), 6) AS quality, MAX(p.us) AS latest FROM positions_v p JOIN (SELECT trader_id, MAX_BY(total_score, us) AS score FROM scores_v GROUP BY trader_id) s ON s.trader_id = p.trader_id GROUP BY p.coin, p.direction, CAST(FLOOR(p.us / {6 * HOUR}) AS BIGINT)"
SQL["agg_scalar_subquery"] = "SELECT t.trader_id, COALESCE(f.n, 0) AS fills, COALESCE(s.n, 0) AS scores FROM traders_v t LEFT JOIN (SELECT trader_id, COUNT(*) AS n FROM fills_v GROUP BY trader_id) f ON f.trader_id = t.trader_id LEFT JOIN (SELECT trader_id, COUNT(*) AS n FROM scores_v GROUP BY trader_id) s ON s.trader_id = t.trader_id"
SQL["agg_bool_ratio"] = f"SELECT t.trader_id, ROUND(COALESCE(AVG(CASE WHEN f.side = 'buy' THEN 1e0 WHEN f.side = 'sell' THEN 0e0 END), 0.5e0), 6) AS buy_ratio FROM traders_v t LEFT JOIN (SELECT trader_id, side FROM fills_v WHERE us > {NOW - 3 * DAY}) f ON f.trader_id = t.trader_id GROUP BY t.trader_id"
SQL["agg_minmax_window"] = f"SELECT coin, MIN(price) AS lo, MAX(price) AS hi FROM market_v WHERE us BETWEEN {NOW - 9 * DAY} AND {NOW - 8 * DAY} GROUP BY coin"
SQL["agg_stddev_samp"] = "SELECT trader_id, ROUND(COALESCE(STDDEV_SAMP(price), 0e0), 6) AS sd FROM fills_v GROUP BY trader_id"
SQL["agg_stddev_pop"] = "SELECT trader_id, ROUND(STDDEV_POP(price), 6) AS sd FROM fills_v GROUP BY trader_id"
SQL["agg_downside_sd"] = "SELECT trader_id, ROUND(COALESCE(STDDEV_SAMP(CASE WHEN price < 50e0 THEN price - 50e0 END), 0e0), 6) AS downside FROM fills_v GROUP BY trader_id"
SQL["agg_cv"] = "SELECT trader_id, ROUND(CASE WHEN ABS(AVG(size)) <= 1e-9 THEN 0e0 ELSE COALESCE(STDDEV_SAMP(size), 0e0) / ABS(AVG(size)) END, 6) AS cv FROM fills_v GROUP BY trader_id"
SQL["agg_sharpe_like"] = "SELECT trader_id, ROUND(CASE WHEN COALESCE(STDDEV_SAMP(r), 0e0) <= 1e-9 THEN 0e0 ELSE AVG(r) / STDDEV_SAMP(r) END, 6) AS sharpe, ROUND(CASE WHEN COALESCE(STDDEV_SAMP(r), 0e0) <= 1e-9 THEN 0e0 ELSE AVG(r) / STDDEV_SAMP(r) * SQRT(CAST(COUNT(*) AS DOUBLE)) END, 6) AS sharpe_sim FROM (SELECT trader_id, price - 50e0 AS r FROM fills_v) x GROUP BY trader_id"
SQL["agg_sharpe_daily_deploy"] = """SELECT trader_id, ROUND(CASE WHEN n < 2 OR sd <= 1e-12 THEN 0e0 ELSE mu / sd * SQRT(n * 365e0 / span) END, 6) AS sharpe FROM (SELECT trader_id, CAST(COUNT(*) AS DOUBLE) AS n, AVG(r) AS mu, STDDEV_POP(r) AS sd, CAST(GREATEST(MAX(day_no) - MIN(day_no) + 1, 1) AS DOUBLE) AS span FROM
(SELECT trader_id, $days(day) AS day_no, SUM(pnl) / SUM(notional) AS r FROM (SELECT trader_id, CAST(ts AS DATE) AS day, COALESCE(closed_pnl_usd, 0e0) AS pnl, price * size AS notional FROM fills_v) z GROUP BY trader_id, $days(day)) d GROUP BY trader_id) x"""
SQL["agg_sharpe_clamped"] = "SELECT trader_id, ROUND(CASE WHEN COUNT(*) < 5 THEN 0e0 ELSE LEAST(GREATEST(AVG(r) / (STDDEV_POP(r) + 1e-9), -2e0), 2e0) END, 6) AS sharpe FROM (SELECT trader_id, price - 50e0 AS r, ROW_NUMBER() OVER (PARTITION BY trader_id ORDER BY us DESC, event_id DESC) AS k FROM fills_v) x WHERE k <= 30 GROUP BY trader_id"
SQL["agg_profit_factor"] = "SELECT trader_id, ROUND(CASE WHEN loss <= 1e-9 THEN CASE WHEN gain > 1e-9 THEN 5e0 ELSE 1e0 END ELSE gain / loss END, 6) AS profit_factor FROM (SELECT trader_id, COALESCE(SUM(CASE WHEN price > 50e0 THEN price - 50e0 END), 0e0) AS gain, COALESCE(-SUM(CASE WHEN price < 50e0 THEN price - 50e0 END), 0e0) AS loss FROM fills_v GROUP BY trader_id) x"
SQL["agg_positive_rate"] = "SELECT trader_id, ROUND(AVG(CASE WHEN price > 50e0 THEN 1e0 ELSE 0e0 END), 6) AS rate FROM fills_v GROUP BY trader_id"
SQL["agg_expectancy"] = """SELECT trader_id, ROUND(wr * COALESCE(w, 0e0) + (1e0 - wr) * COALESCE(l, 0e0), 6) AS expectancy, ROUND(w / NULLIF(ABS(l), 0e0), 6) AS payoff FROM (SELECT trader_id, AVG(CASE WHEN price > 50e0 THEN 1e0 ELSE 0e0 END) AS wr, AVG(CASE WHEN price > 50e0 THEN price - 50e0 END) AS w, AVG(CASE WHEN price <= 50e0 THEN price - 50e0 END) AS l FROM fills_v GROUP BY trader_id) x"""
SQL["agg_recovery_factor"] = """SELECT trader_id, ROUND(CASE WHEN n < 2 OR ABS(a) <= 1e-9 THEN 0e0 ELSE (z / a - 1e0) * 100e0 / GREATEST(dd, 1e0) END, 6) AS recovery FROM (SELECT trader_id, COUNT(*) AS n, MIN_BY(equity, us) AS a, MAX_BY(equity, us) AS z, MAX((peak - equity) / peak * 100e0) AS dd FROM
(SELECT trader_id, us, equity, GREATEST(MAX(equity) OVER (PARTITION BY trader_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1e-9) AS peak FROM pnl_v) c GROUP BY trader_id) x"""
SQL["agg_regime_breakdown"] = "SELECT regime, COUNT(*) AS n, ROUND(AVG(CASE WHEN reference_price > 50e0 THEN 100e0 ELSE 0e0 END), 6) AS win_rate, ROUND(AVG(reference_price), 6) AS avg_return, ROUND(SUM(reference_price), 4) AS total FROM signals_v GROUP BY regime"
SQL["agg_percentile_cont"] = "SELECT ROUND(percentile_cont(0.5) WITHIN GROUP (ORDER BY s), 6) AS p50, ROUND(percentile_cont(0.9) WITHIN GROUP (ORDER BY s), 6) AS p90 FROM (SELECT trader_id, MAX_BY(total_score, us) AS s FROM scores_v GROUP BY trader_id) x"
SQL["agg_inventory"] = "SELECT 'fills' AS name, COUNT(*) AS n FROM fills_v UNION ALL SELECT 'traders', COUNT(*) FROM traders_v UNION ALL SELECT 'scores', COUNT(*) FROM scores_v UNION ALL SELECT 'promoted', COUNT(DISTINCT trader_id) FROM ranks_v WHERE promoted"
_TABLES = {"fills": "fills_v", "ticks": "ticks_v", "positions": "positions_v", "pnl": "pnl_v", "market": "market_v", "scores": "scores_v"}
SQL["agg_freshness"] = "SELECT " + ", ".join(f"{t}.n AS {t}_n, {t}.m AS {t}_max, ({NOW} - {t}.m) / 1e6 AS {t}_lag" for t in _TABLES) + " FROM " + " CROSS JOIN ".join(f"(SELECT COUNT(*) AS n, MAX(us) AS m FROM {v}) {t}" for t, v in _TABLES.items())
SQL["agg_liquidity_baseline"] = f"SELECT coin, CAST(FLOOR(us / {HOUR}) AS BIGINT) % 24 AS utc_hour, ROUND(AVG((ask - bid) / mid * 1e4), 6) AS mu, ROUND(STDDEV_SAMP((ask - bid) / mid * 1e4), 6) AS sigma, COUNT(*) AS n_samples FROM book_v WHERE mid > 0e0 GROUP BY coin, CAST(FLOOR(us / {HOUR}) AS BIGINT) % 24"
SQL["agg_ohlcv_bars"] = f"SELECT coin, CAST(FLOOR(us / {HOUR}) AS BIGINT) AS bar, MIN_BY(price, us) AS open, MAX(price) AS high, MIN(price) AS low, MAX_BY(price, us) AS close, SUM(size) AS volume, COUNT(*) AS n FROM ticks_v GROUP BY coin, CAST(FLOOR(us / {HOUR}) AS BIGINT)"
SQL["agg_vwap_bucket"] = f"SELECT coin, CAST(FLOOR(us / {6 * HOUR}) AS BIGINT) AS bucket, ROUND(SUM(CASE WHEN side = 'buy' THEN price * size END) / NULLIF(SUM(CASE WHEN side = 'buy' THEN size END), 0e0), 6) AS buy_vwap, ROUND(SUM(CASE WHEN side = 'sell' THEN price * size END) / NULLIF(SUM(CASE WHEN side = 'sell' THEN size END), 0e0), 6) AS sell_vwap, COUNT(*) AS n, ROUND(SUM(closed_pnl_usd), 4) AS pnl FROM fills_v GROUP BY coin, CAST(FLOOR(us / {6 * HOUR}) AS BIGINT)"
SQL["agg_orders_markers"] = f"SELECT CAST(FLOOR(status_us / {30 * DAY}) AS BIGINT) AS bucket, COUNT(*) FILTER (WHERE status = 'filled') AS filled, COUNT(*) FILTER (WHERE status = 'open') AS opened, COUNT(*) FILTER (WHERE status = 'triggered') AS triggered FROM orders_snap_v GROUP BY CAST(FLOOR(status_us / {30 * DAY}) AS BIGINT)"
SQL["agg_book_bucket"] = f"SELECT b.coin, CAST(FLOOR(b.us / {6 * HOUR}) AS BIGINT) AS bucket, ROUND(AVG(b.ask - b.bid), 6) AS spread, ROUND(AVG((b.ask - b.bid) / NULLIF(b.mid, 0e0) * 1e4), 6) AS bps, MAX_BY(b.bid, f.size * 1e9 + b.event_id) AS bid_of_largest FROM book_v b JOIN fills_v f ON f.event_id = b.event_id GROUP BY b.coin, CAST(FLOOR(b.us / {6 * HOUR}) AS BIGINT)"
SQL["agg_list_collect"] = f"SELECT CAST(FLOOR(us / {12 * HOUR}) AS BIGINT) AS bucket, COUNT(*) AS n, $list(event_id) AS ids FROM conn_v GROUP BY CAST(FLOOR(us / {12 * HOUR}) AS BIGINT)"
SQL["agg_coin_counts"] = "SELECT coin, COUNT(*) AS n FROM fills_v GROUP BY coin"
SQL["agg_time_bounds"] = f"SELECT coin, GREATEST(MIN(us) - {7 * DAY}, 0) AS lo, MAX(us) + {7 * DAY} AS hi FROM fills_v GROUP BY coin"
SQL["agg_coverage"] = f"SELECT coin, MIN(us) <= {NOW - 29 * DAY} + {HOUR} AND MAX(us) >= {NOW - 2 * DAY} - {HOUR} AS covered FROM market_v GROUP BY coin"
SQL["agg_pnl_histogram"] = "SELECT bucket, COUNT(*) AS n FROM (SELECT CASE WHEN closed_pnl_usd < -40e0 THEN '1' WHEN closed_pnl_usd < -10e0 THEN '2' WHEN closed_pnl_usd < 0e0 THEN '3' WHEN closed_pnl_usd < 10e0 THEN '4' WHEN closed_pnl_usd < 50e0 THEN '5' ELSE '6' END AS bucket FROM fills_v WHERE closed_pnl_usd IS NOT NULL) x GROUP BY bucket"
SQL["agg_hit_rate_history"] = "SELECT trader_id, ROUND(CASE WHEN COUNT(d) >= 5 THEN AVG(CASE WHEN d > 0e0 THEN 1e0 WHEN d IS NOT NULL THEN 0e0 END) END, 6) AS hit_rate FROM (SELECT trader_id, equity - LAG(equity) OVER (PARTITION BY trader_id ORDER BY us, event_id) AS d FROM pnl_v) x GROUP BY trader_id"
SQL["agg_backfill_priority"] = "SELECT wallet, n, CAST(ROW_NUMBER() OVER (ORDER BY n ASC NULLS FIRST, wallet) AS BIGINT) AS priority FROM (SELECT t.wallet, f.n FROM traders_v t LEFT JOIN (SELECT trader_id, COUNT(*) AS n FROM fills_v WHERE coin = 'purchase' GROUP BY trader_id) f ON f.trader_id = t.trader_id WHERE t.wallet_status = 'PROMOTED') x"

# --- windows ---------------------------------------------------------------------
_W = "(PARTITION BY trader_id, coin ORDER BY us, event_key"
SQL["win_running_position"] = f"SELECT event_key, SUM(CASE WHEN side = 'buy' THEN size ELSE -size END) OVER {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS position FROM fills_v"
SQL["win_lag_ts"] = f"SELECT event_key, LAG(us, 1) OVER {_W}) AS prev_us FROM fills_v"
SQL["win_rownum_desc"] = "SELECT event_key, trader_id, coin FROM (SELECT event_key, trader_id, coin, ROW_NUMBER() OVER (PARTITION BY trader_id, coin ORDER BY us DESC, event_key DESC) AS r FROM fills_v) x WHERE r = 1"
SQL["win_lag_return"] = "SELECT event_id, coin, ROUND(CASE WHEN prev > 0e0 THEN (price / prev - 1e0) * 1e4 END, 6) AS ret_bps FROM (SELECT event_id, coin, price, LAG(price) OVER (PARTITION BY coin ORDER BY us, event_id) AS prev FROM market_v) x"
SQL["win_lead_pair"] = "SELECT event_id, us AS connected, next_us AS ended, next_outcome AS outcome FROM conn_next_v WHERE kind = 'ws_connected' AND next_kind = 'ws_session_cycle_complete'"
SQL["win_lead_gap"] = f"SELECT us AS gap_start, next_us AS gap_end, (next_us - us) / 1e6 AS gap_sec FROM conn_next_v WHERE next_us - us > {MINUTE}"
SQL["win_distinct_on_latest"] = "SELECT trader_id, total_score, us FROM (SELECT trader_id, total_score, us, ROW_NUMBER() OVER (PARTITION BY trader_id ORDER BY us DESC, event_id DESC) AS r FROM scores_v) x WHERE r = 1"
SQL["win_distinct_on_first"] = f"SELECT trader_id, coin, direction, w, us, entry_price FROM (SELECT trader_id, coin, direction, us, entry_price, CAST(FLOOR(us / {6 * HOUR}) AS BIGINT) AS w, ROW_NUMBER() OVER (PARTITION BY trader_id, coin, direction, CAST(FLOOR(us / {6 * HOUR}) AS BIGINT) ORDER BY us, event_id) AS r FROM positions_v) x WHERE r = 1"
SQL["win_distinct_on_day"] = "SELECT trader_id, CAST(ts AS DATE) AS day, ROUND(MAX_BY(equity, us), 6) AS equity FROM pnl_v GROUP BY trader_id, CAST(ts AS DATE)"
SQL["win_hourly_last"] = f"SELECT trader_id, CAST(FLOOR(us / {HOUR}) AS BIGINT) AS hour_no, ROUND(MAX_BY(equity, us), 6) AS equity FROM pnl_v GROUP BY trader_id, CAST(FLOOR(us / {HOUR}) AS BIGINT)"
SQL["win_curve_returns"] = "SELECT trader_id, event_id, ROUND((equity / prev - 1e0) * 1e4, 6) AS ret_bps FROM (SELECT trader_id, event_id, equity, LAG(equity) OVER (PARTITION BY trader_id ORDER BY us, event_id) AS prev FROM pnl_v) x WHERE ABS(prev) > 1e-9"
SQL["win_running_max_drawdown"] = "SELECT trader_id, ROUND(MAX(CASE WHEN peak > 1e-9 THEN (peak - equity) / peak * 100e0 ELSE 0e0 END), 6) AS max_dd FROM (SELECT trader_id, equity, GREATEST(0e0, MAX(equity) OVER (PARTITION BY trader_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM pnl_v) x GROUP BY trader_id"
SQL["win_gap_sessionize"] = f"""SELECT trader_id, coin, direction, seg, COUNT(*) AS n, FLOOR((MAX(us) - MIN(us)) / 1e6) / 3600e0 AS hours FROM (SELECT trader_id, coin, direction, us, CAST(SUM(brk) OVER (PARTITION BY trader_id, coin, direction ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS seg FROM
(SELECT trader_id, coin, direction, us, event_id, CASE WHEN us - LAG(us) OVER (PARTITION BY trader_id, coin, direction ORDER BY us, event_id) > {45 * MINUTE} THEN 1 ELSE 0 END AS brk FROM positions_v) a) b GROUP BY trader_id, coin, direction, seg"""
SQL["win_streaks"] = """SELECT trader_id, MAX(CASE WHEN win = 1 THEN n ELSE 0 END) AS max_wins, MAX(CASE WHEN win = 0 THEN n ELSE 0 END) AS max_losses FROM (SELECT trader_id, win, grp, COUNT(*) AS n FROM (SELECT trader_id, win, ROW_NUMBER() OVER (PARTITION BY trader_id ORDER BY us, event_id) - ROW_NUMBER() OVER (PARTITION BY trader_id, win ORDER BY us, event_id) AS grp FROM
(SELECT trader_id, us, event_id, CASE WHEN price > 50e0 THEN 1 ELSE 0 END AS win FROM fills_v) a) b GROUP BY trader_id, win, grp) c GROUP BY trader_id"""
SQL["win_rolling_days_hit"] = """SELECT trader_id, day_no, CASE WHEN n >= 4 THEN ROUND(CAST(w AS DOUBLE) / n, 6) END AS hit FROM (SELECT trader_id, day_no, SUM(n) OVER (PARTITION BY trader_id ORDER BY day_no RANGE BETWEEN 30 PRECEDING AND CURRENT ROW) AS n, SUM(w) OVER (PARTITION BY trader_id ORDER BY day_no RANGE BETWEEN 30 PRECEDING AND CURRENT ROW) AS w FROM
(SELECT trader_id, CAST($days(day) AS BIGINT) AS day_no, COUNT(*) AS n, SUM(CASE WHEN price > 50e0 THEN 1 ELSE 0 END) AS w FROM (SELECT trader_id, price, CAST(ts AS DATE) AS day FROM fills_v) z GROUP BY trader_id, CAST($days(day) AS BIGINT)) d) x"""
SQL["win_percentile_midrank"] = "SELECT trader_id, ROUND(CASE WHEN n = 1 THEN 50e0 ELSE (lo + (ties - 1) / 2e0 - 1e0) * 100e0 / (n - 1) END, 6) AS pct FROM (SELECT trader_id, RANK() OVER (ORDER BY v) AS lo, COUNT(*) OVER (PARTITION BY v) AS ties, COUNT(*) OVER () AS n FROM (SELECT trader_id, ROUND(AVG(price), 2) AS v FROM fills_v GROUP BY trader_id) a) b"
SQL["win_peer_percentile"] = "SELECT trader_id, ROUND(CASE WHEN COUNT(*) OVER () < 2 THEN 55e0 ELSE 100e0 * CUME_DIST() OVER (ORDER BY v) END, 6) AS pct FROM (SELECT trader_id, ROUND(AVG(price), 2) AS v FROM fills_v GROUP BY trader_id) a"
SQL["win_minmax_norm"] = """WITH a AS (SELECT trader_id, AVG(price) AS v FROM fills_v GROUP BY trader_id), s AS (SELECT MIN(v) AS lo, MAX(v) AS hi, AVG(v) AS mu, STDDEV_SAMP(v) AS sd FROM a), z AS (SELECT trader_id, CASE WHEN hi - lo <= 1e-12 THEN 0.5e0 ELSE (v - lo) / (hi - lo) END AS norm, CASE WHEN sd IS NULL OR sd <= 1e-12 THEN 0e0 ELSE (v - mu) / sd END AS z FROM a CROSS JOIN s),
zs AS (SELECT MIN(z) AS zlo, MAX(z) AS zhi FROM z)
SELECT trader_id, ROUND(norm, 6) AS norm, ROUND(z, 6) AS z, ROUND(CASE WHEN zhi - zlo <= 1e-12 THEN 0.5e0 ELSE (z - zlo) / (zhi - zlo) END, 6) AS z_norm FROM z CROSS JOIN zs"""
SQL["win_rank_order"] = "SELECT trader_id, CAST(ROW_NUMBER() OVER (ORDER BY v DESC, trader_id) AS BIGINT) AS position FROM (SELECT trader_id, ROUND(AVG(price), 4) AS v FROM fills_v GROUP BY trader_id) a"
SQL["win_last_n"] = "SELECT trader_id, event_key FROM (SELECT trader_id, event_key, ROW_NUMBER() OVER (PARTITION BY trader_id ORDER BY us DESC, event_key DESC) AS r FROM fills_v) x WHERE r <= 10"
SQL["win_first_passage"] = f"""SELECT signal_id, COALESCE(MIN_BY(price, CASE WHEN price >= ref * 1.2e0 OR price <= ref * 0.8e0 THEN us END), MAX_BY(price, us)) AS exit_price, MIN(CASE WHEN price >= ref * 1.2e0 OR price <= ref * 0.8e0 THEN us END) IS NOT NULL AS crossed FROM
(SELECT s.signal_id, s.reference_price AS ref, m.price, m.us FROM signals_v s JOIN market_v m ON m.coin = s.coin AND m.us BETWEEN s.window_end AND s.window_end + {12 * HOUR}) p GROUP BY signal_id"""
SQL["win_walk_forward_split"] = """SELECT trader_id, n_days, CAST(LEAST(GREATEST(FLOOR(0.67e0 * n_days), 1), n_days - 1) AS BIGINT) AS split_at, COUNT(*) FILTER (WHERE d <= LEAST(GREATEST(FLOOR(0.67e0 * n_days), 1), n_days - 1)) AS train, COUNT(*) FILTER (WHERE d > LEAST(GREATEST(FLOOR(0.67e0 * n_days), 1), n_days - 1)) AS test FROM
(SELECT trader_id, d, MAX(d) OVER (PARTITION BY trader_id) AS n_days FROM (SELECT trader_id, CAST(DENSE_RANK() OVER (PARTITION BY trader_id ORDER BY CAST(ts AS DATE)) AS BIGINT) AS d FROM fills_v) a) b WHERE n_days >= 4 GROUP BY trader_id, n_days"""

# --- sorts, limits, set operations --------------------------------------------------
SQL["srt_multi_key"] = "SELECT trader_id, behavior_tier, CAST(ROW_NUMBER() OVER (ORDER BY behavior_tier DESC NULLS LAST, last_seen DESC, trader_id) AS BIGINT) AS place FROM traders_v"
SQL["srt_case_rank"] = "SELECT trader_id, CAST(ROW_NUMBER() OVER (ORDER BY CASE wallet_status WHEN 'PROMOTED' THEN 0 WHEN 'WATCHLIST' THEN 1 WHEN 'DISCOVERED' THEN 2 ELSE 3 END, trader_id) AS BIGINT) AS place FROM traders_v"
SQL["lim_page"] = "SELECT trader_id, wallet FROM (SELECT trader_id, wallet FROM traders_v ORDER BY trader_id LIMIT 25 OFFSET 50) p"
SQL["lim_topk"] = "SELECT wallet, vlm FROM (SELECT wallet, ROUND(vlm, 2) AS vlm FROM leaderboard_v ORDER BY vlm DESC, wallet LIMIT 25) p"
SQL["lim_latest_reverse"] = "SELECT event_id, us, CAST(ROW_NUMBER() OVER (ORDER BY us, event_id) AS BIGINT) AS place FROM (SELECT event_id, us FROM pnl_v WHERE trader_id = 7 ORDER BY us DESC, event_id DESC LIMIT 30) p"
SQL["lim_cap_promotions"] = """WITH s AS (SELECT wallet_id, wallet, (50e0 + wallet_id % 50) * LOG10(GREATEST(vlm, 1e0)) AS score FROM leaderboard_v), top AS (SELECT wallet_id FROM s ORDER BY score DESC, wallet LIMIT 40)
SELECT s.wallet, top.wallet_id IS NOT NULL AS kept FROM s LEFT JOIN top ON top.wallet_id = s.wallet_id"""
SQL["lim_distinct_on_limit"] = "SELECT trader_id, total_score FROM (SELECT trader_id, MAX_BY(total_score, us) AS total_score FROM scores_v GROUP BY trader_id ORDER BY trader_id LIMIT 20) x"
SQL["set_union_all"] = "SELECT buyer AS trader_id, coin, price * size AS notional, TRUE AS is_buy FROM ticks_v UNION ALL SELECT seller, coin, price * size, FALSE FROM ticks_v"
SQL["set_concat_relaxed"] = "SELECT event_id, coin, price, CAST(NULL AS DOUBLE) AS size FROM market_v UNION ALL SELECT event_id, coin, price, size FROM ticks_v"
SQL["ded_merge_first"] = "SELECT event_key, us, price FROM (SELECT event_key, us, price, ROW_NUMBER() OVER (PARTITION BY event_key ORDER BY us, src, event_key) AS r FROM (SELECT event_key, us, price, 0 AS src FROM fills_v UNION ALL SELECT event_key, us + 1, price + 1e0, 1 FROM fills_v WHERE event_id % 2 = 0) u) x WHERE r = 1"
SQL["ded_order_snapshots"] = "SELECT oid, o_orderkey, status FROM (SELECT oid, o_orderkey, status, ROW_NUMBER() OVER (PARTITION BY oid ORDER BY CASE status WHEN 'filled' THEN 4 WHEN 'canceled' THEN 3 WHEN 'triggered' THEN 2 WHEN 'open' THEN 1 ELSE 0 END DESC, status_us DESC, o_orderkey DESC) AS r FROM orders_snap_v) x WHERE r = 1"
SQL["ded_unique_last"] = "SELECT oid, o_orderkey FROM (SELECT oid, o_orderkey, ROW_NUMBER() OVER (PARTITION BY oid ORDER BY status_us DESC, o_orderkey DESC) AS r FROM orders_snap_v) x WHERE r = 1"
SQL["ded_unique_first"] = "SELECT oid, o_orderkey FROM (SELECT oid, o_orderkey, ROW_NUMBER() OVER (PARTITION BY oid ORDER BY o_orderkey) AS r FROM orders_snap_v) x WHERE r = 1"
SQL["ded_lru_window"] = """SELECT event_key, MIN(us) AS us, COUNT(*) AS seen FROM (SELECT event_key, us FROM fills_v UNION ALL SELECT event_key, us + 1 FROM fills_v WHERE event_id % 3 = 0
UNION ALL SELECT 'tick|' || coin || '|' || CAST(event_id AS STRING), us FROM ticks_v UNION ALL SELECT 'tick|' || coin || '|' || CAST(event_id AS STRING), us FROM ticks_v WHERE event_id % 5 = 0
UNION ALL SELECT 'position|' || CAST(trader_id AS STRING) || '|' || coin || '|' || CAST(us AS STRING), us FROM positions_v UNION ALL SELECT 'market|' || coin || '|' || CAST(us AS STRING), us FROM market_v) u GROUP BY event_key"""
SQL["ded_alert_daily"] = "SELECT trader_id, day, alert FROM (SELECT DISTINCT trader_id, CAST(ts AS DATE) AS day, 'leverage' AS alert FROM positions_v WHERE leverage > 8e0) a WHERE NOT EXISTS (SELECT 1 FROM alerts_v h WHERE h.trader_id = a.trader_id AND h.day = a.day AND h.alert = a.alert)"
SQL["ded_group_wallets"] = "SELECT DISTINCT LOWER(wallet) AS wallet FROM traders_v"

# --- what Spark reads where one text won't do for both ---------------------------------
#: Spark's division by 0 is an error; DuckDB's is NaN or an infinity, as IEEE has it.
_IEEE = "CASE WHEN SUM(notional) <> 0 THEN SUM(pnl) / SUM(notional) WHEN SUM(pnl) > 0 THEN DOUBLE('Infinity') WHEN SUM(pnl) < 0 THEN DOUBLE('-Infinity') WHEN SUM(pnl) = 0 THEN DOUBLE('NaN') END"
SPARK = {"agg_sharpe_daily_deploy": SQL["agg_sharpe_daily_deploy"].replace("SUM(pnl) / SUM(notional)", _IEEE)}
