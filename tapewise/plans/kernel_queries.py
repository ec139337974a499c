"""Each formula over a whole view, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewise.functions import kernels as k
from tapewise.plans.dialect import duck, view
from tapewise.plans.views import NOW

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _clamp(x: str, lo: str = "0e0", hi: str = "100e0") -> str:
    return f"LEAST(GREATEST({x}, {lo}), {hi})"


def _sig(x: str, mid: str, steep: str) -> str:
    return f"(1e0 / (1e0 + EXP(-{steep} * ({x} - {mid}))))"


def add(name: str, source: str, key: str, columns: dict[str, tuple[Callable[[], Column], str]]) -> None:
    """Register columns as (expression, SQL) over a view; doubles are rounded to 6
    places. Expressions are built when the query runs, as they need a session."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = view(spark, sf_dir, source).select(key, *(e().alias(n) for n, (e, _) in columns.items()))
        return out.select(*(k.rounded(n, 6).alias(n) if t == "double" and n != key else c(n) for n, t in out.dtypes))

    QUERIES[name] = run
    fields = ", ".join(f"{s if s.startswith('CASE /*s*/') or s.startswith('(/*s*/') else f'ROUND({s}, 6)'} AS {n}" for n, (_, s) in columns.items())
    ORACLE_SQL[name] = duck(f"SELECT {key}, {fields} FROM {source}")


_S = "CASE /*s*/"  # marks SQL that isn't a double

add("k_sigmoid", "fills_v", "event_id", {"s": (lambda: k.sigmoid(c("price"), 50.0, 0.1), _sig("price", "50e0", "0.1e0")), "b": (lambda: k.bell(c("price"), 50.0, 20.0), "EXP(-0.5e0 * ((price - 50e0) / 20e0) * ((price - 50e0) / 20e0))")})
add("k_shrink", "scores_v", "event_id", {"conf": (lambda: k.confidence(c("total_score"), 20), _clamp("SQRT(total_score / 20e0)", "0e0", "1e0")), "shrunk": (lambda: k.shrink(c("total_score"), k.confidence(c("total_score"), 80)), _clamp(f"50e0 + (total_score - 50e0) * {_clamp('SQRT(total_score / 80e0)', '0e0', '1e0')}"))})
add("k_weighted_average", "fills_v", "event_id", {"w": (lambda: k.weighted((c("price"), 0.4), (c("size"), 0.35), (c("fee_usd"), 0.25)), "price * 0.4e0 + size * 0.35e0 + fee_usd * 0.25e0")})
add("flt_finite", "fills_v", "event_id", {"f": (lambda: k.finite(F.when(c("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(c("price"))), "CASE WHEN event_id % 3 = 0 THEN 0e0 ELSE price END")})
add("k_entry_edge_bps", "fills_v", "event_id", {"edge": (lambda: k.entry_edge_bps(c("side"), c("price"), c("price") * 1.01 + 1), "CASE side WHEN 'buy' THEN ((price * 1.01e0 + 1e0) / GREATEST(ABS(price), 1e0) - 1e0) * 1e4 ELSE (GREATEST(ABS(price), 1e0) / GREATEST(ABS(price * 1.01e0 + 1e0), 1e0) - 1e0) * 1e4 END")})
add("k_rank_tier", "ranks_v", "event_id", {"tier": (lambda: k.rank_tier(F.lit(None).cast("string"), c("event_id") % 40 == 0, c("promoted"), c("activity_score"), c("discovery_score")), _S + " WHEN event_id % 40 = 0 THEN 'whale' WHEN promoted AND activity_score >= 80 AND discovery_score >= 70 THEN 'elite' WHEN promoted AND discovery_score >= 60 THEN 'active_tracked' WHEN discovery_score >= 72 THEN 'high_quality' WHEN discovery_score >= 45 THEN 'watchlist' ELSE 'monitored' END")})
add("k_age_minutes", "traders_v", "trader_id", {"age": (lambda: k.age_minutes(F.when(c("trader_id") % 5 != 0, c("last_seen")), NOW), f"CASE WHEN trader_id % 5 = 0 THEN 10000e0 ELSE GREATEST(FLOOR(({NOW} - last_seen) / 6e7), 0e0) END")})
add("k_regime", "market_v", "event_id", {"regime": (lambda: k.market_regime(c("funding_rate"), c("open_interest"), c("price") - 50, c("price")), _S + " WHEN open_interest > 0 AND ABS(funding_rate) < 0.001e0 AND ABS(price - 50e0) > 12 THEN 'trend_expansion' WHEN ABS(funding_rate) >= 0.0015e0 THEN 'crowded' WHEN price > 90 THEN 'volatile' ELSE 'balanced' END")})
_MOM = "(" + _clamp("CASE direction WHEN 'long' THEN (entry_price - 50e0) / 25e0 ELSE (50e0 - entry_price) / 25e0 END", "-1e0", "1e0") + " + 1e0) * 50e0"
_VOL = "CASE WHEN entry_price >= 150 THEN 20e0 WHEN entry_price >= 90 THEN 45e0 WHEN entry_price <= 20 THEN 70e0 ELSE 85e0 END"
def _mom() -> Column:
    return k.momentum_score(c("direction"), c("entry_price") - 50, c("entry_price") - 50)


add("k_momentum_score", "positions_v", "event_id", {"m": (_mom, _MOM)})
add("k_vol_regime", "positions_v", "event_id", {"r": (lambda: k.vol_regime(c("entry_price")), _S + " WHEN entry_price >= 150 THEN 'extreme' WHEN entry_price >= 90 THEN 'high' WHEN entry_price <= 20 THEN 'low' ELSE 'normal' END")})
add("k_vol_score", "positions_v", "event_id", {"v": (lambda: k.vol_score(c("entry_price")), _VOL)})
add("k_confidence", "positions_v", "event_id", {"conf": (lambda: k.signal_confidence(c("leverage"), 3, c("entry_price"), _mom(), c("entry_price")), _clamp(f"LEAST(leverage / 3e0, 2e0) / 2e0 * 100e0 * 0.25e0 + {_clamp('entry_price / 100e0', '0e0', '1e0')} * 100e0 * 0.4e0 + {_MOM} * 0.2e0 + {_VOL} * 0.15e0"))})
add("k_passes", "positions_v", "event_id", {"ok": (lambda: (_mom() >= 45) & (k.vol_score(c("entry_price")) >= 25), f"(/*s*/{_MOM} >= 45 AND {_VOL} >= 25)")})
_RET = "CASE WHEN reference_price <= 0 THEN 0e0 WHEN direction = 'long' THEN ({p} / NULLIF(reference_price, 0e0) - 1e0) * 1e4 ELSE (reference_price / NULLIF({p}, 0e0) - 1e0) * 1e4 END"


def _exit() -> Column:
    return c("confidence") + 1


add("k_dir_return_bps", "signals_v", "signal_id", {"r": (lambda: k.directional_return_bps(c("direction"), c("reference_price"), _exit()), _RET.format(p="(confidence + 1e0)"))})
add("k_mfe", "signals_v", "signal_id", {"mfe": (lambda: k.favorable_bps(c("direction"), c("reference_price"), _exit() + 5, _exit()), f"GREATEST(CASE direction WHEN 'long' THEN {_RET.format(p='(confidence + 6e0)')} ELSE {_RET.format(p='(confidence + 1e0)')} END, 0e0)")})
add("k_mae", "signals_v", "signal_id", {"mae": (lambda: k.adverse_bps(c("direction"), c("reference_price"), _exit() + 5, _exit()), f"LEAST(CASE direction WHEN 'long' THEN {_RET.format(p='(confidence + 1e0)')} ELSE {_RET.format(p='(confidence + 6e0)')} END, 0e0)")})
add("k_outcome_label", "fills_v", "event_id", {"label": (lambda: k.outcome_label(c("price") - 50), _S + " WHEN price - 50e0 >= 35 THEN 'strong_win' WHEN price - 50e0 > 0 THEN 'win' WHEN price - 50e0 <= -35 THEN 'loss' ELSE 'flat' END")})
add("k_risk_fraction", "signals_v", "signal_id", {"r": (lambda: k.risk_fraction(c("confidence"), F.lit(0.015), F.lit(0.03), F.lit(0.015)), "LEAST(GREATEST(0.015e0 + confidence / 100e0 * 0.015e0, 0.015e0), 0.03e0)")})
add("k_effective_slippage", "signals_v", "signal_id", {"bps": (lambda: k.effective_slippage(4.0, F.lit(0.02), c("confidence"), c("reference_price"), c("reference_price") / 2, c("reference_price") / 4, F.lit("high")), f"4e0 * (1e0 + {_clamp('reference_price / 80e0', '0e0', '2e0')}) * (1e0 + {_clamp('(ABS(reference_price / 2e0) + ABS(reference_price / 4e0)) / 100e0', '0e0', '1e0')} * 0.15e0) * 1.25e0 * (1e0 + confidence / 100e0 * 0.2e0) * 1.2e0")})
add("k_apply_slippage", "signals_v", "signal_id", {"entry": (lambda: k.apply_slippage(c("direction"), c("reference_price"), F.lit(8.0), True), "CASE direction WHEN 'long' THEN reference_price * 1.0008e0 ELSE reference_price * 0.9992e0 END"), "exit": (lambda: k.apply_slippage(c("direction"), c("reference_price"), F.lit(8.0), False), "CASE direction WHEN 'long' THEN reference_price * 0.9992e0 ELSE reference_price * 1.0008e0 END")})
add("k_open_close", "tape_v", "event_key", {"opens": (lambda: F.lower(F.trim("fill_dir")).startswith("open"), "(/*s*/LOWER(TRIM(fill_dir)) LIKE 'open%')"), "closes": (lambda: F.lower(F.trim("fill_dir")).startswith("close"), "(/*s*/LOWER(TRIM(fill_dir)) LIKE 'close%')")})
add("k_signed_delta", "tape_v", "event_key", {"d": (lambda: k.signed_delta(c("fill_dir"), F.lit("buy"), c("size"), c("price")), "CASE WHEN price > 0 AND size > 0 THEN CASE WHEN fill_dir IN ('Open Long', 'Close Short') THEN size ELSE -size END END")})
add("k_linear_slip", "fills_v", "event_id", {"worse": (lambda: c("price") * F.when(c("side") == "buy", 1.0005).otherwise(0.9995), "price * CASE side WHEN 'buy' THEN 1.0005e0 ELSE 0.9995e0 END")})


def _leg(i: int) -> Column:
    return k.leg_size(c("price") * c("size"), 0.5, c("price") * 10, 0.2, 150.0, 10.0)[i]


_LEG = "LEAST(price * size * 0.5e0, LEAST(price * 10e0 * 0.2e0, 150e0))"
add("k_leg_size", "fills_v", "event_id", {"usd": (lambda: _leg(0), f"CASE WHEN {_LEG} < 10 THEN 0e0 ELSE {_LEG} END"), "why": (lambda: _leg(1), f"{_S} WHEN {_LEG} < 10 THEN 'DUST' WHEN price * size * 0.5e0 > LEAST(price * 10e0 * 0.2e0, 150e0) THEN 'RISK_CAP' ELSE 'OK' END")})


def _stake(x: str) -> Column:
    last = F.when(c("event_id") % 4 == 0, c("price") * 3)
    return k.kelly_size(c("price") / 100, c("size") / 2, F.lit(10_000.0), c("size") / 5, F.when(c("event_id") % 6 == 0, 0.0).otherwise(c("price") / 1000), last)[x]


_P = "(price / 100e0)"
_B = "(size / 2e0)"
_KELLY = f"(({_P} * {_B} - (1e0 - {_P})) / {_B})"
_K = f"(10000e0 * {_KELLY} * 0.25e0 * GREATEST(size / 5e0, 0.2e0) * CASE WHEN {_P} >= 0.5e0 THEN 1e0 ELSE 0.6e0 END)"
_ST = f"(CASE WHEN event_id % 6 = 0 OR price <= 0 THEN {_K} ELSE 100e0 / (price / 1000e0) END)"
_FREE = f"LEAST({_ST}, {_K}, 1500e0)"
_HELD = f"(CASE WHEN event_id % 4 = 0 AND price > 0 THEN LEAST({_FREE}, price * 3e0 * 1.05e0) ELSE {_FREE} END)"
_NAME = f"CASE WHEN {_ST} <= LEAST({_K}, 1500e0) THEN 'stop' WHEN {_K} <= 1500e0 THEN 'kelly' ELSE 'max_cap' END"
add(
    "k_kelly_size",
    "fills_v",
    "event_id",
    {
        "stake": (lambda: _stake("usd"), f"CASE WHEN {_KELLY} <= 0 THEN 0e0 ELSE {_HELD} END"),
        "bound": (lambda: _stake("bound"), f"{_S} WHEN {_KELLY} <= 0 OR {_HELD} < 1 THEN 'dust' WHEN {_HELD} < {_FREE} - 1e-9 THEN 'ratchet' ELSE {_NAME} END"),
        "skip": (lambda: _stake("skip"), f"{_S} WHEN {_KELLY} <= 0 THEN 'NEGATIVE_EXPECTANCY' WHEN {_HELD} < 1 THEN 'DUST' END"),
    },
)
_EDGE = f"{_S} WHEN wr < 0.45e0 THEN 'WIN_RATE_TOO_LOW' WHEN wr * gain - (1e0 - wr) * loss < 0.002e0 THEN 'INSUFFICIENT_EDGE' ELSE 'OK' END"
_GATE = f"{_S} WHEN n < 20 THEN 'INSUFFICIENT_TRIPS' WHEN copy < 0.3e0 THEN 'LOW_COPYABILITY' ELSE 'OK' END"
_VERDICT = f"""{_S} WHEN n = 0 THEN 'NO_DATA' WHEN ({_EDGE}) <> 'OK' THEN 'FILTERED_EDGE' WHEN ({_GATE}) <> 'OK' THEN 'FILTERED_COPYABILITY'
WHEN dynamic_pct > 0 AND (CASE WHEN ABS(exchange_pct) < 1e-9 THEN 1e300 ELSE ABS(dynamic_pct / exchange_pct) END) <= 20 THEN 'LIVE_CANDIDATE' WHEN dynamic_pct >= -2 THEN 'MONITOR' ELSE 'REVIEW' END"""
add("k_edge_filter", "edge_v", "trader_id", {"reason": (lambda: k.edge_filter(c("wr"), c("gain"), c("loss")), _EDGE)})
add("k_copyability_gate", "edge_v", "trader_id", {"reason": (lambda: k.copyability_gate(c("copy"), c("n")), _GATE)})
add("k_variance_drain", "edge_v", "trader_id", {"drain": (lambda: k.variance_drain_pct(c("copy") * 15, c("n")), "copy * copy * 225e0 * n / 200e0")})
add("k_verdict", "edge_v", "trader_id", {"verdict": (lambda: k.verdict(k.edge_filter(c("wr"), c("gain"), c("loss")), k.copyability_gate(c("copy"), c("n")), c("dynamic_pct"), c("exchange_pct"), c("n")), _VERDICT)})
add("k_stop_distance", "fills_v", "event_id", {"stop": (lambda: F.coalesce(F.when(c("event_id") % 3 == 0, c("price") / 1000), F.when(c("coin") == "click", 0.02), F.lit(0.03)), "COALESCE(CASE WHEN event_id % 3 = 0 THEN price / 1000e0 END, CASE WHEN coin = 'click' THEN 0.02e0 END, 0.03e0)")})
add("k_timing_from_hold", "fills_v", "event_id", {"t": (lambda: k.timing_from_hold(c("price") * 3), "CASE WHEN price * 3e0 < 1 THEN 25e0 * GREATEST(price * 3e0, 0e0) WHEN price * 3e0 < 4 THEN 25e0 + 20e0 * (price * 3e0 - 1e0) / 3e0 WHEN price * 3e0 <= 48 THEN 92e0 WHEN price * 3e0 <= 168 THEN GREATEST(25e0, 92e0 * (1e0 - (price * 3e0 - 48e0) / 120e0)) ELSE GREATEST(8e0, 25e0 * EXP(-(price * 3e0 - 168e0) / 240e0)) END")})
add("k_linear_score", "fills_v", "event_id", {"up": (lambda: k.linear_score(c("price"), 90.0, 40.0), f"{_clamp('(price - 40e0) / 50e0', '0e0', '1e0')} * 100e0"), "down": (lambda: k.linear_score(c("price"), 6.0, 168.0), f"{_clamp('(price - 168e0) / (6e0 - 168e0)', '0e0', '1e0')} * 100e0")})
add("k_completeness", "fills_v", "event_id", {"comp": (lambda: k.completeness(c("price"), c("size") * 5, c("event_id") % 2 == 0), "LEAST(100e0, LEAST(price / 100e0, 1e0) * 35e0 + LEAST(size * 5e0 / 30e0, 1e0) * 40e0 + CASE WHEN event_id % 2 = 0 THEN 25e0 ELSE LEAST(price / 50e0, 1e0) * 10e0 END)"), "conf": (lambda: k.average_confidence(c("price"), c("size") * 5, F.lit(0)), "(LEAST(1e0, SQRT(price / 50e0)) + LEAST(1e0, SQRT(size * 5e0 / 30e0)) + LEAST(1e0, SQRT(size * 5e0 / 20e0)) + LEAST(1e0, SQRT(price / 20e0))) / 5e0")})
add("k_behavior_tier", "scores_v", "event_id", {"tier": (lambda: k.behavior_tier(F.when(c("event_id") % 6 != 0, c("total_score")), c("total_score") / 100, F.lit(90.0)), _S + " WHEN event_id % 6 = 0 THEN 'watchlist' WHEN total_score >= 75 AND total_score / 100e0 >= 0.7e0 THEN 'high_quality' WHEN total_score >= 40 AND total_score / 100e0 >= 0.5e0 THEN 'active_tracked' ELSE 'watchlist' END")})
add("k_hf_label", "fills_v", "event_id", {"label": (lambda: k.hf_label(c("event_id") * 10, c("price")), _S + " WHEN event_id * 10 = 0 THEN 'NEW_WALLET' WHEN event_id * 10 >= 10000 AND price < 30 THEN 'ULTRA_HF_BOT' WHEN event_id * 10 >= 10000 AND price < 90 THEN 'HIGH_FREQUENCY' WHEN event_id * 10 >= 10000 OR price >= 90 THEN 'NORMAL' ELSE 'NEW_WALLET' END")})
add("k_spread_bps", "book_v", "event_id", {"bps": (lambda: k.spread_bps(c("bid"), c("ask")), "CASE WHEN (bid + ask) / 2e0 > 0 THEN (ask - bid) / ((bid + ask) / 2e0) * 1e4 END")})
_SPOT = "CASE WHEN LOWER(status) LIKE '%cancel%' OR LOWER(status) LIKE '%reject%' THEN 'spot_limit_canceled' WHEN reduce_only THEN 'spot_limit_close' WHEN side = 'B' THEN 'spot_limit_buy' WHEN side = 'A' THEN 'spot_limit_sell' ELSE 'other' END"
_PERP = "CASE WHEN LOWER(status) LIKE '%cancel%' THEN CASE WHEN side = CASE WHEN reduce_only THEN 'B' ELSE 'A' END THEN 'canceled_short' ELSE 'canceled' END WHEN side = 'A' THEN CASE WHEN reduce_only THEN 'long_close' ELSE 'short_open' END WHEN side = 'B' THEN CASE WHEN reduce_only THEN 'short_close' ELSE 'long_open' END ELSE 'other' END"
add("k_order_kind", "intents_v", "o_orderkey", {"kind": (lambda: k.order_kind(c("status"), c("side"), c("reduce_only"), c("coin")), f"{_S} WHEN TRIM(coin) LIKE '@%' THEN {_SPOT} ELSE {_PERP} END"), "ambiguous": (lambda: k.order_ambiguous(c("coin"), c("reduce_only")), "(/*s*/TRIM(coin) NOT LIKE '@%' AND NOT reduce_only)")})
add("k_segment_clip", "signals_v", "signal_id", {"len": (lambda: (F.least(c("window_end") + 7_200_000_000, F.lit(NOW - 864_000_000_000)) - F.greatest(c("window_end"), F.lit(NOW - 1_728_000_000_000))).cast("double"), f"CAST(LEAST(window_end + 7200000000, {NOW - 864_000_000_000}) - GREATEST(window_end, {NOW - 1_728_000_000_000}) AS DOUBLE)")})
add("k_channel_status", "fills_v", "event_id", {"status": (lambda: k.channel_status(F.when(c("event_id") % 7 != 0, c("price") * 10)), _S + " WHEN event_id % 7 = 0 THEN 'missing' WHEN price * 10e0 > 900 THEN 'critical' WHEN price * 10e0 > 300 THEN 'warn' ELSE 'ok' END")})
add("k_whale_tier", "whales_v", "wallet_id", {"tier": (lambda: k.whale_tier(c("vlm")), _S + " WHEN vlm >= 1000000000 THEN 'mega' WHEN vlm >= 100000000 THEN 'whale' WHEN vlm >= 10000000 THEN 'large' ELSE 'active' END")})
_HIT = "COALESCE(hit >= 55, FALSE)"
add(
    "k_should_promote",
    "whales_v",
    "wallet_id",
    {
        "promote": (lambda: k.should_promote(c("vlm"), c("hit"), c("roi"), least_volume=1e7, least_hit=55.0, elite=False), f"(/*s*/vlm >= 10000000 AND roi > 0 AND ({_HIT} OR vlm >= 100000000 OR (vlm >= 50000000 AND roi >= 0.08e0)))"),
        "elite": (lambda: k.should_promote(c("vlm"), c("hit"), c("roi"), least_volume=1e7, least_hit=55.0, elite=True), f"(/*s*/vlm >= 10000000 AND roi > 0 AND ({_HIT} OR (vlm >= 100000000 AND roi >= 0.1e0)))"),
    },
)
add("k_marker_size", "fills_v", "event_id", {"px": (lambda: k.clamp(c("size") / 3.0, 0.25, 4.0) * 8.0, f"{_clamp('size / 3e0', '0.25e0', '4e0')} * 8e0")})
add("prj_context_json", "signals_v", "signal_id", {"ctx": (lambda: F.to_json(F.struct("coin", "regime")), """CASE /*s*/ WHEN TRUE THEN '{"coin":"' || coin || '","regime":"' || regime || '"}' END""")})
