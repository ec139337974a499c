"""Bundle scores, slippage models and factor ranking over the domain views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewise.functions import bundle
from tapewise.functions import kernels as k
from tapewise.functions.factors import FactorRegistry, RankingConfig, rank
from tapewise.functions.slippage import LinearBps
from tapewise.operators.fifo import round_trips, slipped
from tapewise.plans.dialect import duck, spark, view
from tapewise.plans.scoring import METRICS, bell, clamp, conf, mix, shrunk
from tapewise.plans.trading import FIFO, FIFO_NET
from tapewise.plans.views import DAY

QUERIES = {}
ORACLE_SQL = {}


# --- bundle score ----------------------------------------------------------------------
def _measures(s, d) -> DataFrame:
    fills = view(s, d, "tape_v")
    at = (F.floor(F.col("us") / DAY) * DAY).alias("us")
    candles = fills.groupBy("coin", at).agg(F.max_by("price", F.struct("event_key")).alias("close"))
    return bundle.measures(fills, candles)


def p_bundle_score(s, d):
    """Pillars, total and style of every wallet from its own fills and daily candles."""
    out = bundle.score(_measures(s, d))
    return out.select("trader_id", "style", *(k.rounded(x, 4).alias(x) for x in out.columns if x not in ("trader_id", "style")))


def k_metric_score_abs(s, d):
    """0 to 100 for each measure of a wallet."""
    rows = _measures(s, d)
    return rows.select("trader_id", *(k.rounded(bundle.metric_score(n), 4).alias(n) for n in (*bundle.CURVES, "hit_rate_pct", "favorable_entry_rate_pct")))


def _sig(x: str, mid: float, steep: float) -> str:
    return f"(1e0 / (1e0 + EXP(LEAST(-{steep}e0 * ({x} - {mid}e0), 700e0))))"


def _curve(name: str) -> str:
    if name not in bundle.CURVES:
        return clamp(name)
    mid, steep, up = bundle.CURVES[name]
    x = _sig(f"CAST({name} AS DOUBLE)", mid, steep)
    return f"({x if up else f'(1e0 - {x})'} * 100e0)"


_SQL = f"""{FIFO},
dp AS (SELECT trader_id, CAST(FLOOR(us / {DAY}) AS BIGINT) AS day, COALESCE(SUM(closed_pnl_usd), 0e0) AS pnl FROM tape_v GROUP BY trader_id, CAST(FLOOR(us / {DAY}) AS BIGINT)),
de AS (SELECT trader_id, day, GREATEST(ROUND(10000e0 + SUM(pnl) OVER (PARTITION BY trader_id ORDER BY day), 6), 1e0) AS equity FROM dp),
dr AS (SELECT *, MAX(equity) OVER (PARTITION BY trader_id ORDER BY day) AS peak, (equity / LAG(equity) OVER (PARTITION BY trader_id ORDER BY day) - 1e0) * 1e4 AS r FROM de),
ca AS (SELECT trader_id, COUNT(*) AS active_days, COUNT(r) AS returns, COALESCE(AVG(r), 0e0) AS expectancy_bps, COALESCE(STDDEV_SAMP(r), 0e0) AS return_vol_bps, COALESCE(STDDEV_SAMP(r) FILTER (WHERE r < 0), 0e0) AS downside_vol_bps, COALESCE(100e0 * COUNT(*) FILTER (WHERE r > 0) / NULLIF(COUNT(r), 0), 0e0) AS hit_rate_pct, MAX((peak - equity) / peak * 100e0) AS max_drawdown_pct, FIRST(equity ORDER BY day) AS a, LAST(equity ORDER BY day) AS z, COALESCE(SUM(r) FILTER (WHERE r > 0), 0e0) AS gains, COALESCE(-SUM(r) FILTER (WHERE r < 0), 0e0) AS losses FROM dr GROUP BY trader_id),
ow AS (SELECT trader_id, COUNT(*) AS fills, COALESCE(STDDEV_SAMP(size * price) / AVG(size * price), 0e0) AS sizing_cv FROM tape_v GROUP BY trader_id),
ho AS (SELECT trader_id, AVG((c.us - o.us) / 3.6e9) AS h FROM cut WHERE hi - lo > 1e-9 AND o IS NOT NULL AND c IS NOT NULL GROUP BY trader_id),
cn AS (SELECT coin, CAST(FLOOR(us / {DAY}) AS BIGINT) * {DAY} AS us, LAST(price ORDER BY event_key) AS px FROM tape_v GROUP BY coin, CAST(FLOOR(us / {DAY}) AS BIGINT)),
ed AS (SELECT t.trader_id, CASE WHEN fill_dir IN ('Open Long', 'Close Short') THEN (px / GREATEST(ABS(price), 1e0) - 1e0) * 1e4 ELSE (GREATEST(ABS(price), 1e0) / GREATEST(ABS(px), 1e0) - 1e0) * 1e4 END AS e FROM tape_v t ASOF JOIN cn ON cn.coin = t.coin AND cn.us >= t.us),
ea AS (SELECT trader_id, COUNT(e) AS edges, AVG(e) AS entry_timing_edge_bps, 100e0 * COUNT(*) FILTER (WHERE e > 0) / COUNT(e) AS favorable_entry_rate_pct FROM ed GROUP BY trader_id),
ms AS (SELECT ca.*, fills, sizing_cv, COALESCE(h, 0e0) AS avg_holding_hours, COALESCE(edges, 0) AS edges, COALESCE(entry_timing_edge_bps, 0e0) AS entry_timing_edge_bps, COALESCE(favorable_entry_rate_pct, 0e0) AS favorable_entry_rate_pct, CASE WHEN return_vol_bps <= 1e-9 THEN 0e0 ELSE expectancy_bps / return_vol_bps END AS sharpe_like, CASE WHEN losses > 1e-9 THEN gains / losses WHEN gains > 1e-9 THEN 5e0 ELSE 1e0 END AS profit_factor,
 CASE WHEN active_days < 2 THEN 0e0 ELSE (z / a - 1e0) * 100e0 / GREATEST(max_drawdown_pct, 1e0) END AS recovery_factor FROM ca JOIN ow ON ow.trader_id = ca.trader_id LEFT JOIN ea ON ea.trader_id = ca.trader_id LEFT JOIN ho ON ho.trader_id = ca.trader_id)"""
_PIL = {p: shrunk(mix(*((_curve(n), w) for n, w in parts.items())), f"LEAST({', '.join(conf(n, t) for n, t in bundle.EVIDENCE[p].items())})") for p, parts in bundle.PILLARS.items()}
_FITS = {
    "scalp": mix((f"(1e0 - {_sig('avg_holding_hours', 4, 0.5)})", 0.45), (_sig("fills", 50, 0.04), 0.30), (bell("0e0", 5, 3), 0.15), (f"(1e0 - {_sig('sizing_cv', 0.8, 3)})", 0.10)),
    "momentum": "CASE WHEN entry_timing_edge_bps <= 0 OR expectancy_bps <= 0 THEN 0e0 ELSE " + mix((_sig("entry_timing_edge_bps", 10, 0.15), 0.40), (_sig("expectancy_bps", 5, 0.2), 0.30), (_sig("favorable_entry_rate_pct", 55, 0.12), 0.20), (bell("avg_holding_hours", 12, 20), 0.10)) + " END",
    "mean_reversion": "CASE WHEN entry_timing_edge_bps >= 0 OR expectancy_bps <= 0 THEN 0e0 ELSE " + mix((_sig("(-entry_timing_edge_bps)", 5, 0.15), 0.40), (_sig("expectancy_bps", 3, 0.25), 0.25), (_sig("(profit_factor - 1e0)", 0.5, 1.5), 0.20), (_sig("recovery_factor", 1, 0.8), 0.15)) + " END",
    "swing": mix((_sig("avg_holding_hours", 24, 0.06), 0.45), (f"(1e0 - {_sig('fills', 20, 0.08)})", 0.25), (f"(1e0 - {_sig('max_drawdown_pct', 15, 0.1)})", 0.20), (f"(1e0 - {_sig('0e0', 3, 0.4)})", 0.10)),
}
_ARMS = " UNION ALL ".join(f"SELECT trader_id, '{n}' AS name, {i} AS o, {clamp(x, hi='1e0')} AS fit FROM ms" for i, (n, x) in enumerate(_FITS.items()))
_STYLED = f"""ft AS ({_ARMS}), rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY trader_id ORDER BY fit DESC, o) AS n FROM ft),
sy AS (SELECT a.trader_id, CASE WHEN a.fit < 0.35e0 OR (a.name <> 'swing' AND a.fit - b.fit < 0.05e0) THEN 'unknown' ELSE a.name END AS style, CASE WHEN a.fit < 0.35e0 THEN a.fit ELSE a.fit - b.fit END AS sure FROM rk a JOIN rk b ON b.trader_id = a.trader_id AND a.n = 1 AND b.n = 2)"""
_TOTAL = clamp(mix(*((("50e0" if p == "leverage" else p), w) for p, w in bundle.SHARES.items())))
ORACLE_SQL["p_bundle_score"] = f"""WITH {_SQL}, {_STYLED}, pl AS (SELECT trader_id, active_days, {', '.join(f'{x} AS {p}' for p, x in _PIL.items())} FROM ms)
SELECT pl.trader_id, CASE WHEN active_days < 2 THEN 'unknown' ELSE style END AS style, {', '.join(f'CASE WHEN active_days < 2 THEN 50e0 ELSE ROUND({p}, 4) END AS {p}' for p in _PIL)}, 50e0 AS leverage, CASE WHEN active_days < 2 THEN 50e0 ELSE ROUND({_TOTAL}, 4) END AS total, CASE WHEN active_days < 2 THEN 0e0 ELSE ROUND(sure, 4) END AS style_confidence FROM pl JOIN sy ON sy.trader_id = pl.trader_id"""
ORACLE_SQL["k_metric_score_abs"] = f"WITH {_SQL} SELECT trader_id, {', '.join(f'ROUND({_curve(n)}, 4) AS {n}' for n in (*bundle.CURVES, 'hit_rate_pct', 'favorable_entry_rate_pct'))} FROM ms"

# --- slippage --------------------------------------------------------------------------
MODELS = (LinearBps(0.0), LinearBps(5.0), LinearBps(20.0))


def p_slippage_models(s, d):
    """What each model leaves of a wallet's trips, matched once."""
    trips = round_trips(view(s, d, "tape_v"))
    for i, m in enumerate(MODELS):
        trips = slipped(trips, m).withColumnRenamed("net", f"net_{i}")
    # summed side by side, so that trips are matched and shuffled once for all models
    sums = trips.groupBy("trader_id").agg(F.count("*").alias("trips"), F.sum("notional").alias("notional"), *(F.sum(f"net_{i}").alias(f"net_{i}") for i in range(len(MODELS))))
    each = sums.select("trader_id", "trips", "notional", F.explode(F.array(*(F.struct(F.lit(m.identifier).alias("model"), F.col(f"net_{i}").alias("net")) for i, m in enumerate(MODELS)))).alias("_m")).select("*", "_m.*")
    return each.select("trader_id", "model", "trips", k.rounded("net", 2).alias("net"), k.rounded(F.col("net") / F.col("notional") * 1e4, 4).alias("net_bps"))


_NET = "(CASE side WHEN 'long' THEN exit_px * (1e0 - w) - entry_px * (1e0 + w) ELSE entry_px * (1e0 - w) - exit_px * (1e0 + w) END) * qty - o_fee * qty / o_size - c_fee * qty / c_size"
ORACLE_SQL["p_slippage_models"] = f"""WITH {FIFO}, md AS (SELECT * FROM (VALUES {', '.join(f"('{m.identifier}', {m.bps / 1e4!r}::DOUBLE)" for m in MODELS)}) v(model, w))
SELECT trader_id, model, COUNT(*) AS trips, ROUND(SUM({_NET}), 2) AS net, ROUND(SUM({_NET}) / SUM(qty * entry_px) * 1e4, 4) AS net_bps FROM trip CROSS JOIN md GROUP BY trader_id, model"""

# --- factor ranking --------------------------------------------------------------------
RANKING = RankingConfig.of({
    "version": "2024.01",
    "decay_half_life_days": 30,
    "normalization": "minmax",
    "weights": {"sharpe": 0.35, "pnl_consistency": 0.20, "win_rate": 0.15, "low_drawdown": 0.10, "recent_performance": 0.20},
    "factor_caps": {"sharpe": 0.95},
})
#: Factors as SQL over a trader's metrics; both engines read these alone.
FACTORS = {"sharpe": "sharpe_like", "pnl_consistency": "profit_factor", "win_rate": "hit_rate_pct", "low_drawdown": "-max_drawdown_pct", "recent_performance": "expectancy_bps"}


def p_factor_ranking(s, d):
    """All traders with metrics, by the weighted factors of ``RANKING``."""
    registry = FactorRegistry()
    for name, text in FACTORS.items():
        registry.register(name, lambda text=text: F.expr(text))
    metrics = spark(f"WITH {METRICS} SELECT * FROM m")(s, d)
    return rank(metrics, "trader_id", registry, RANKING, digits=6)


_UNIT = ", ".join(f"CASE WHEN MAX({n}) OVER () - MIN({n}) OVER () <= 1e-9 * GREATEST(ABS(MAX({n}) OVER ()), ABS(MIN({n}) OVER ())) THEN 0.5e0 ELSE ({n} - MIN({n}) OVER ()) / (MAX({n}) OVER () - MIN({n}) OVER ()) END AS {n}" for n in FACTORS)
_SUM = " + ".join(f"{w}e0 * LEAST({n}, {RANKING.caps.get(n, 1.0)}e0)" for n, w in RANKING.weights.items())
ORACLE_SQL["p_factor_ranking"] = f"""WITH {METRICS}, fa AS (SELECT trader_id, {', '.join(f'CAST({x} AS DOUBLE) AS {n}' for n, x in FACTORS.items())} FROM m), un AS (SELECT trader_id, {_UNIT} FROM fa), sc AS (SELECT trader_id, ROUND({_SUM}, 6) AS score FROM un)
SELECT trader_id, score, ROW_NUMBER() OVER (ORDER BY score DESC, trader_id) AS place FROM sc"""

QUERIES = {f.__name__: f for f in (p_bundle_score, k_metric_score_abs, p_slippage_models, p_factor_ranking)}
ORACLE_SQL = {n: duck(q) for n, q in ORACLE_SQL.items()}
