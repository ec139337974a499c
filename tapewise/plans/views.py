"""Domain views over the data folder's tables. Times are microseconds (``us``).

The trading tables don't exist in the data folder, so each is a deterministic
view of ``events`` (30 days of 2024-01) or ``lineitem``. Clocks are constants:
every query takes its ``as_of`` from here.
"""

DAY = 86_400_000_000
HOUR = 3_600_000_000
MINUTE = 60_000_000
#: 2024-01-31 00:00 UTC, just after the last event.
NOW = 1_706_659_200_000_000
#: 2001-11-05 00:00 UTC, just after the last shipment.
NOW_SHIP = 1_004_918_400_000_000

VIEWS = {
    "ev_v": "SELECT event_id, ts, $us(ts) AS us, user_id, event_type, value, props FROM @events",
    "traders_v": f"""SELECT user_id AS trader_id, 'w' || CAST(user_id AS STRING) AS wallet, MIN(us) AS first_seen, MAX(us) AS last_seen,
        CASE user_id % 4 WHEN 0 THEN 'PROMOTED' WHEN 1 THEN 'WATCHLIST' WHEN 2 THEN 'DISCOVERED' ELSE 'BANNED' END AS wallet_status,
        CASE WHEN user_id % 5 = 0 THEN NULL ELSE {NOW - DAY} END AS filter_updated_us,
        CASE WHEN user_id % 7 = 0 THEN 'high_quality' ELSE NULL END AS behavior_tier FROM ev_v GROUP BY user_id""",
    "fills_v": """SELECT event_id, user_id AS trader_id, event_type AS coin, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
        value AS price, CAST(1 + event_id % 5 AS DOUBLE) AS size, us, ts,
        'fill|w' || CAST(user_id AS STRING) || '|' || event_type || '|' || CAST(event_id AS STRING) AS event_key,
        CASE WHEN event_id % 3 = 0 THEN value - 50e0 ELSE NULL END AS closed_pnl_usd, value * 0.0004e0 AS fee_usd FROM ev_v""",
    "positions_v": """SELECT event_id, user_id AS trader_id, event_type AS coin, CASE WHEN event_id % 2 = 0 THEN 'long' ELSE 'short' END AS direction,
        value AS entry_price, CAST(1 + event_id % 10 AS DOUBLE) AS leverage, us, ts FROM ev_v""",
    "pnl_v": """SELECT event_id, user_id AS trader_id, us, ts, 10000e0 + SUM(value - 50e0) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM ev_v""",
    "market_v": """SELECT event_id, event_type AS coin, value AS price, CAST((event_id % 7) - 3 AS DOUBLE) / 1000e0 AS funding_rate, CAST(user_id * 1000 AS DOUBLE) AS open_interest, us, ts FROM ev_v""",
    "ticks_v": """SELECT event_id, event_type AS coin, user_id AS buyer, (user_id * 7 + 3) % 150 AS seller, value AS price, CAST(1 + event_id % 5 AS DOUBLE) AS size, us FROM ev_v""",
    "scores_v": """SELECT event_id, user_id AS trader_id, CAST((event_id * 7) % 100 AS DOUBLE) AS total_score, CASE event_id % 4 WHEN 0 THEN 'scalp' WHEN 1 THEN 'swing' WHEN 2 THEN 'momentum' ELSE 'unknown' END AS style, us FROM ev_v WHERE event_id % 3 = 0""",
    "ranks_v": """SELECT event_id, user_id AS trader_id, (user_id % 3) <> 0 AS promoted, CAST((event_id * 13) % 100 AS DOUBLE) AS discovery_score, CAST((event_id * 17) % 100 AS DOUBLE) AS activity_score, us FROM ev_v WHERE event_id % 4 = 0""",
    "conn_v": """SELECT event_id, us, CASE event_type WHEN 'signup' THEN 'ws_connected' ELSE 'ws_session_cycle_complete' END AS kind, $json(props, k) AS outcome FROM ev_v WHERE event_type IN ('signup', 'error')""",
    "conn_next_v": f"""SELECT c.event_id, c.us, c.kind, c.outcome, COALESCE(c.nu, d.nu) AS next_us, CASE WHEN c.nu IS NULL THEN d.nk ELSE c.nk END AS next_kind, CASE WHEN c.nu IS NULL THEN d.nx ELSE c.nx END AS next_outcome FROM
        (SELECT q.*, LEAD(us) OVER (PARTITION BY day ORDER BY us, event_id) AS nu, LEAD(kind) OVER (PARTITION BY day ORDER BY us, event_id) AS nk, LEAD(outcome) OVER (PARTITION BY day ORDER BY us, event_id) AS nx FROM (SELECT conn_v.*, CAST(FLOOR(us / {DAY}) AS BIGINT) AS day FROM conn_v) q) c
        JOIN (SELECT day, LEAD(u) OVER (ORDER BY day) AS nu, LEAD(k) OVER (ORDER BY day) AS nk, LEAD(NULLIF(x, '')) OVER (ORDER BY day) AS nx FROM (SELECT CAST(FLOOR(us / {DAY}) AS BIGINT) AS day, MIN(us) AS u, MIN_BY(kind, us) AS k, MIN_BY(COALESCE(outcome, ''), us) AS x FROM conn_v GROUP BY CAST(FLOOR(us / {DAY}) AS BIGINT)) f) d ON d.day = c.day""",
    "tape_v": """SELECT l_suppkey AS trader_id, 'C' || CAST(l_partkey % 5 AS STRING) AS coin, l_quantity AS size, l_extendedprice / l_quantity AS price,
        $us(l_shipdate) AS us, CAST(l_shipdate AS DATE) AS day,
        CASE WHEN l_returnflag = 'A' THEN 'Open Long' WHEN l_returnflag = 'R' THEN 'Close Long' WHEN l_linestatus = 'O' THEN 'Open Short' ELSE 'Close Short' END AS fill_dir,
        CASE WHEN l_returnflag = 'R' OR (l_returnflag = 'N' AND l_linestatus = 'F') THEN l_extendedprice * (l_tax - l_discount) ELSE NULL END AS closed_pnl_usd,
        l_extendedprice * 0.00035e0 AS fee_usd,
        CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || '-' || CAST(CAST(ROUND(l_extendedprice * 100e0) AS BIGINT) AS STRING) AS event_key
        FROM @lineitem""",
    "book_v": """SELECT event_id, event_type AS coin, us, ts, value - 0.01e0 * (event_id % 9 + 1) AS bid, value + 0.01e0 * (event_id % 9 + 1) AS ask, value AS mid FROM ev_v WHERE event_id % 2 = 0""",
    "signals_v": """SELECT event_id AS signal_id, event_type AS coin, CASE WHEN event_id % 2 = 0 THEN 'long' ELSE 'short' END AS direction, value AS reference_price,
        us AS window_end, CAST((event_id * 11) % 100 AS DOUBLE) AS confidence, CASE event_id % 4 WHEN 0 THEN 'trend_expansion' WHEN 1 THEN 'crowded' WHEN 2 THEN 'volatile' ELSE 'balanced' END AS regime FROM ev_v WHERE event_id % 25 = 0""",
    "edge_v": """SELECT trader_id, COUNT(*) AS n, AVG(CASE WHEN price > 50e0 THEN 1e0 ELSE 0e0 END) AS wr, COALESCE(AVG(CASE WHEN price > 50e0 THEN (price - 50e0) / 1000e0 END), 0e0) AS gain,
        COALESCE(AVG(CASE WHEN price <= 50e0 THEN (50e0 - price) / 1000e0 END), 0e0) AS loss, (trader_id % 10) / 10e0 AS copy, (SUM(price) - 50e0 * COUNT(*)) / 100e0 AS dynamic_pct,
        CASE WHEN trader_id % 11 = 0 THEN 0e0 ELSE COALESCE(SUM(closed_pnl_usd), 0e0) / 400e0 END AS exchange_pct FROM fills_v GROUP BY trader_id""",
    "intents_v": """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'marginCanceled' WHEN o_orderkey % 11 = 0 THEN 'perpMarginRejected' ELSE status END AS status, CASE o_orderkey % 13 WHEN 0 THEN 'X' ELSE CASE o_orderkey % 2 WHEN 0 THEN 'B' ELSE 'A' END END AS side,
        o_orderkey % 3 = 0 AS reduce_only, CASE o_orderkey % 5 WHEN 0 THEN '@107' WHEN 1 THEN ' @1 ' WHEN 2 THEN 'kPEPE' ELSE 'BTC' END AS coin FROM orders_snap_v""",
    "alerts_v": """SELECT DISTINCT trader_id, CAST(ts AS DATE) AS day, 'leverage' AS alert FROM positions_v WHERE leverage > 8e0 AND event_id % 3 = 0""",
    "whales_v": """SELECT wallet_id, wallet, n_orders, vlm * 100e0 AS vlm, CASE WHEN wallet_id % 4 = 0 THEN NULL ELSE CAST(wallet_id % 100 AS DOUBLE) END AS hit, account_value / 50000e0 AS roi FROM leaderboard_v""",
    "registry_v": """SELECT 'W' || CAST(c_custkey AS STRING) AS wallet FROM @customer WHERE c_acctbal > 5000e0""",
    "orders_snap_v": """SELECT o_orderkey % 500 AS oid, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'triggered' END AS status, $us(o_orderdate) AS status_us, o_totalprice AS limit_px, o_orderpriority AS order_type FROM @orders""",
    "leaderboard_v": """SELECT c.c_custkey AS wallet_id, c.c_name AS wallet, c.c_acctbal AS account_value, c.c_nationkey AS nation, COALESCE(SUM(o.o_totalprice), 0e0) AS vlm, COUNT(o.o_orderkey) AS n_orders FROM @customer c LEFT JOIN @orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey, c.c_name, c.c_acctbal, c.c_nationkey""",
}
